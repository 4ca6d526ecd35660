"""Single-byte encodings and glyph names, as far as they follow from rules and public tables."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_ACCENTS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "OGONEK": "ogonek", "MACRON": "macron", "BREVE": "breve", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut", "STROKE": "slash", "COMMA BELOW": "commaaccent"}
_DIGITS = "zero one two three four five six seven eight nine".split()
_SIGNS = (
    "space=0020 exclam=! quotedbl=0022 numbersign=# dollar=$ percent=% ampersand=& quotesingle=0027 quoteright=’ parenleft=( parenright=) asterisk=* plus=+ comma=, hyphen=- period=. slash=/ colon=: "
    "semicolon=; less=< equal=003d greater=> question=? at=@ bracketleft=[ backslash=\\ bracketright=] asciicircum=^ underscore=_ grave=` quoteleft=‘ braceleft={ bar=| braceright=} asciitilde=~ "
    "exclamdown=¡ cent=¢ sterling=£ fraction=⁄ yen=¥ florin=ƒ section=§ currency=¤ quotedblleft=“ guillemotleft=« guilsinglleft=‹ guilsinglright=› fi=ﬁ fl=ﬂ ff=ﬀ ffi=ﬃ ffl=ﬄ endash=– dagger=† "
    "daggerdbl=‡ periodcentered=· paragraph=¶ bullet=• quotesinglbase=‚ quotedblbase=„ quotedblright=” guillemotright=» ellipsis=… perthousand=‰ questiondown=¿ acute=´ circumflex=ˆ tilde=˜ macron=¯ "
    "breve=˘ dotaccent=˙ dieresis=¨ ring=˚ cedilla=¸ hungarumlaut=˝ ogonek=˛ caron=ˇ emdash=— AE=Æ ordfeminine=ª Lslash=Ł Oslash=Ø OE=Œ ordmasculine=º ae=æ dotlessi=ı lslash=ł oslash=ø oe=œ "
    "germandbls=ß onesuperior=¹ logicalnot=¬ mu=µ trademark=™ Eth=Ð onehalf=½ plusminus=± Thorn=Þ onequarter=¼ divide=÷ brokenbar=¦ degree=° thorn=þ threequarters=¾ twosuperior=² registered=® minus=− "
    "eth=ð multiply=× threesuperior=³ copyright=© Euro=€ nbspace=00a0 sfthyphen=00ad softhyphen=00ad infinity=∞ notequal=≠ lessequal=≤ greaterequal=≥ partialdiff=∂ summation=∑ product=∏ pi=π "
    "integral=∫ radical=√ approxequal=≈ Delta=∆ Omega=Ω lozenge=◊ apple=F8FF arrowleft=← arrowup=↑ arrowright=→ arrowdown=↓ dcroat=đ Dcroat=Đ hbar=ħ Hbar=Ħ kgreenlandic=ĸ eng=ŋ Eng=Ŋ longs=ſ "
    "estimated=℮ checkmark=✓ heart=♥ spade=♠ club=♣ diamond=♦ universal=∀ existential=∃ element=∈ emptyset=∅ union=∪ intersection=∩ theta1=ϑ phi1=ϕ omega1=ϖ sigma1=ς"
)


@lru_cache(maxsize=1)
def glyph_names() -> dict[str, str]:
    """Glyph name -> text."""
    out = {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    out |= {name: str(i) for i, name in enumerate(_DIGITS)}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x218, 0x21C)):
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]) WITH ([A-Z ]+?)", unicodedata.name(chr(code), ""))
        if m and m[3] in _ACCENTS:
            out.setdefault((m[2] if m[1] == "CAPITAL" else m[2].lower()) + _ACCENTS[m[3]], chr(code))
    for code in range(0x391, 0x3CA):
        m = re.fullmatch(r"GREEK (CAPITAL|SMALL) LETTER ([A-Z]+)", unicodedata.name(chr(code), ""))
        if m:
            name = {"LAMDA": "LAMBDA"}.get(m[2], m[2])
            out.setdefault(name.capitalize() if m[1] == "CAPITAL" else name.lower(), chr(code))
    for code in range(0x410, 0x450):
        out[f"afii{10017 + code - 0x410 + (code > 0x415) if code < 0x430 else 10065 + code - 0x430 + (code > 0x435)}"] = chr(code)
    for code in (*range(0x401, 0x460), *range(0x5D0, 0x5EB), *range(0x621, 0x64B), *range(0x905, 0xA75), *range(0xA85, 0xAB9), *range(0x3041, 0x3095), *range(0x30A1, 0x30FB), *range(0xFF10, 0xFF5B)):
        own = unicodedata.name(chr(code), "")
        if m := re.fullmatch(r"(?:HIRAGANA|KATAKANA) LETTER (SMALL )?([A-Z]+)", own):
            out.setdefault(m[2].lower() + ("small" if m[1] else "") + own.split()[0].lower(), chr(code))
        elif m := re.fullmatch(r"CYRILLIC (CAPITAL|SMALL) LETTER ([A-Z]+)", own):
            out.setdefault((m[2].capitalize() if m[1] == "CAPITAL" else m[2].lower()) + "cyrillic", chr(code))
        elif m := re.fullmatch(r"(HEBREW|ARABIC|BENGALI|GUJARATI|GURMUKHI|DEVANAGARI) LETTER ([A-Z]+)", own):
            out.setdefault(m[2].lower() + {"DEVANAGARI": "deva"}.get(m[1], m[1].lower()), chr(code))
        elif m := re.fullmatch(r"FULLWIDTH (?:LATIN (CAPITAL|SMALL) LETTER ([A-Z])|DIGIT ([A-Z]+))", own):
            out.setdefault((m[3].lower() if m[3] else m[2] if m[1] == "CAPITAL" else m[2].lower()) + "monospace", chr(code))
    for k in range(26):
        for start, name in ((0x24B6, chr(65 + k) + "circle"), (0x24D0, chr(97 + k) + "circle"), (0x249C, chr(97 + k) + "parenthesized")):
            out.setdefault(name, chr(start + k))
    numbers = [*_DIGITS[1:], *"ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()]
    for k, name in enumerate(numbers):
        out |= {name + "circle": chr(0x2460 + k), name + "parenthesized": chr(0x2474 + k), name + "period": chr(0x2488 + k)}
        if k < 12:
            out |= {name + "roman": chr(0x2170 + k), name.capitalize() + "roman": chr(0x2160 + k)}
    for k, name in enumerate(_DIGITS):
        out |= {name + "superior": chr((0x2070, 0xB9, 0xB2, 0xB3)[k] if k < 4 else 0x2070 + k), name + "inferior": chr(0x2080 + k), name + "arabic": chr(0x660 + k), name + "deva": chr(0x966 + k), name + "bengali": chr(0x9E6 + k), name + "gurmukhi": chr(0xA66 + k), name + "gujarati": chr(0xAE6 + k), name + "thai": chr(0xE50 + k)}
    for pair in _SIGNS.split():
        name, _, said = pair.partition("=")
        out[name] = said if len(said) == 1 else chr(int(said, 16))
    return out


def glyph_text(name: str) -> str:
    """The text of a glyph name; "" for one that says nothing."""
    out = []
    for part in name.split(".")[0].split("_"):
        if part in (known := glyph_names()):
            out.append(known[part])
        elif m := re.fullmatch(r"uni((?:[0-9A-Fa-f]{4})+)", part):
            codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)]
            out += [chr(c) for c in codes if not 0xD800 <= c < 0xE000]
        elif (m := re.fullmatch(r"u([0-9A-Fa-f]{4,6})", part)) and not 0xD800 <= (c := int(m[1], 16)) < 0xE000 and c < 0x110000:
            out.append(chr(c))
    return "".join(out)


def _by_codec(codec: str, patches: dict[int, str]) -> dict[int, str]:
    out = {}
    for code in range(32, 256):
        try:
            out[code] = bytes([code]).decode(codec)
        except UnicodeDecodeError:
            continue
    return out | patches


#: From 0xA1 on, "\0" for none.
_STANDARD_HIGH = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ\0–†‡·\0¶•‚„”»…‰\0¿\0`´ˆ˜¯˘˙¨\0˚¸\0˝˛ˇ—" + "\0" * 16 + "Æ\0ª\0\0\0\0ŁØŒº\0\0\0\0\0æ\0\0\0ı\0\0łøœß"
STANDARD = {c: chr(c) for c in range(32, 127)} | {0x27: "’", 0x60: "‘"} | {0xA1 + i: c for i, c in enumerate(_STANDARD_HIGH) if c != "\0"}
WIN_ANSI = _by_codec("cp1252", {0xA0: " ", 0xAD: "-", **{c: "•" for c in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D)}})
MAC_ROMAN = _by_codec("mac_roman", {0xCA: " ", 0xDB: "¤"})
_SYMBOL_UPPER, _SYMBOL_LOWER = "ΑΒΧ∆ΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ", "αβχδεφγηιϕκλμνοπθρστυϖωξψζ"
SYMBOL = {c: chr(c) for c in range(32, 64)} | {0x22: "∀", 0x24: "∃", 0x27: "∋", 0x2A: "∗", 0x2D: "−", 0x40: "≅", 0x5B: "[", 0x5C: "∴", 0x5D: "]", 0x5E: "⊥", 0x5F: "_", 0x7B: "{", 0x7C: "|", 0x7D: "}", 0x7E: "∼"}
SYMBOL |= {0x41 + i: c for i, c in enumerate(_SYMBOL_UPPER)} | {0x61 + i: c for i, c in enumerate(_SYMBOL_LOWER)}
SYMBOL |= {0xA1 + i: c for i, c in enumerate("ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈")}
DINGBATS = {c: chr(0x2700 + c - 0x20) for c in range(0x21, 0x7F)} | {c: chr(0x2761 + c - 0xA1) for c in range(0xA1, 0xFF) if c != 0xF0}
DINGBATS |= {0x20: " ", 0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕"}
DINGBATS |= {0xAC + i: chr(0x2460 + i) for i in range(10)}
ENCODINGS = {"StandardEncoding": STANDARD, "WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN}

#: Widths of the standard fonts for the characters from space to tilde, with ' and ` as quotesingle and grave.
_TEN = {"H": "556", "T": "500"}
_WIDTHS = {
    "Helvetica": "278 278 355 H H 889 667 191 333 333 389 584 278 333 278 278 H*10 278 278 584 584 584 H 1015 667 667 722 722 667 611 778 722 278 500 667 H 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 H 333 H H 500 H H 278 H H 222 222 500 222 833 H H H H 333 500 278 H 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 H H 889 722 238 333 333 389 584 278 333 278 278 H*10 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 H 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 H 333 H 611 H 611 H 333 611 611 278 278 H 278 889 611 611 611 611 389 H 333 611 H 778 H H 500 389 280 389 584",
    "Times-Roman": "250 333 408 T T 833 778 180 333 333 T 564 250 333 250 278 T*10 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 T 333 444 T 444 T 444 333 T T 278 278 T 278 778 T T T T 333 389 278 T T 722 T T 444 480 200 480 541",
    "Times-Bold": "250 333 555 T T 1000 833 278 333 333 T 570 250 333 250 278 T*10 333 333 570 570 570 T 930 722 667 722 722 667 611 778 778 389 T 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 T 333 T 556 444 556 444 333 T 556 278 333 556 278 833 556 T 556 556 444 389 333 556 T 722 T T 444 394 220 394 520",
    "Times-Italic": "250 333 420 T T 833 778 214 333 333 T 675 250 333 250 278 T*10 333 333 675 675 675 T 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 T 556 722 611 833 611 556 556 389 278 389 422 T 333 T T 444 T 444 278 T T 278 278 444 278 722 T T T T 389 389 278 T 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 T T 833 778 278 333 333 T 570 250 333 250 278 T*10 333 333 570 570 570 T 832 667 667 667 722 667 667 722 778 389 T 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 T 333 T T 444 T 444 333 T 556 278 278 T 278 778 556 T T T 389 389 278 556 444 667 T 444 389 348 220 348 570",
}
#: Of the fonts with encodings of their own, from code 0x20 to 0x7E and from 0xA1 to 0xFE; 0 for no glyph. n*w: n times.
_OWN_WIDTHS = {
    "Symbol": (
        "250 333 713 500 549 833 778 439 2*333 500 549 250 549 250 278 10*500 2*278 3*549 444 549 722 667 722 612 611 763 603 722 333 631 722 686 889 2*722 768 741 556 592 611 690 439 768 645 795 611 333 863 333 658 2*500"
        " 631 2*549 494 439 521 411 603 329 603 2*549 576 521 2*549 521 549 603 439 576 713 686 493 686 494 480 200 480 549",
        "620 247 549 167 713 500 4*753 1042 987 603 987 603 400 549 411 2*549 713 494 460 4*549 1000 603 1000 658 823 686 795 987 2*768 823 2*768 7*713 768 713 2*790 890 823 549 250 713 2*603 1042 987 603 987 603 494 329 2*790 786 713 6*384 4*494 0 329 274 3*686 6*384 3*494",
    ),
    "ZapfDingbats": (
        "278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 760 759 754 494 552 537 577 692 786 2*788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 790 792 695"
        " 776 768 792 759 707 708 682 701 826 815 2*789 707 687 696 689 786 787 713 791 785 791 873 761 2*762 2*759 2*892 788 784 438 138 277 415 2*392 2*668",
        "732 2*544 910 667 2*760 776 595 694 626 40*788 894 838 1016 458 748 924 748 918 927 2*928 834 873 828 2*924 917 930 931 463 883 2*836 2*867 2*696 874 0 874 760 946 771 865 771 888 967 888 831 873 927 970 918",
    ),
}
#: ascent, descent, bounding box
_SHAPES = {
    "Helvetica": (718, -207, (-166, -225, 1000, 931)),
    "Helvetica-Bold": (718, -207, (-170, -228, 1003, 962)),
    "Times-Roman": (683, -217, (-168, -218, 1000, 898)),
    "Times-Bold": (683, -217, (-168, -218, 1000, 935)),
    "Times-Italic": (683, -217, (-169, -217, 1010, 883)),
    "Times-BoldItalic": (683, -217, (-200, -218, 996, 921)),
    "Courier": (629, -157, (-23, -250, 715, 805)),
    "Courier-Bold": (629, -157, (-113, -250, 749, 801)),
    "Courier-Oblique": (629, -157, (-27, -250, 849, 805)),
    "Courier-BoldOblique": (629, -157, (-57, -250, 869, 801)),
    "Helvetica-Oblique": (718, -207, (-170, -225, 1116, 931)),
    "Helvetica-BoldOblique": (718, -207, (-174, -228, 1114, 962)),
    "Symbol": (0, 0, (-180, -293, 1090, 1010)),
    "ZapfDingbats": (0, 0, (-1, -143, 981, 820)),
}
_MORE = {"ﬁ": {"H": 500, "T": 556}, "•": 350, "–": {"H": 556, "T": 500}, "—": 1000, "…": 1000, "‘": 222, "’": 222, "“": 333, "”": 333, "ß": {"H": 611, "T": 500}, "Æ": {"H": 1000, "T": 889}, "æ": {"H": 889, "T": 667}, "ø": {"H": 611, "T": 500}, "Ø": {"H": 778, "T": 722}, "œ": {"H": 944, "T": 722}, "Œ": {"H": 1000, "T": 889}, "«": {"H": 556, "T": 500}, "»": {"H": 556, "T": 500}, "°": 400, "©": {"H": 737, "T": 760}, "®": {"H": 737, "T": 760}, "¿": {"H": 611, "T": 444}, "¡": 333, "€": {"H": 556, "T": 500}}


def core_font(name: str) -> str | None:
    """The standard font that a name stands for."""
    if name in _SHAPES:
        return name
    m = re.fullmatch(r"(Arial|CourierNew|TimesNewRoman)(?:PS)?(?:MT)?(?:[,-]?(Bold)?(Italic|Oblique)?(?:MT)?)", name)
    if not m:
        return None
    family = {"Arial": "Helvetica", "CourierNew": "Courier", "TimesNewRoman": "Times"}[m[1]]
    slant = "" if not m[3] else "Italic" if family == "Times" else "Oblique"
    style = (m[2] or "") + slant
    return f"{family}-{style}" if style else "Times-Roman" if family == "Times" else family


@lru_cache(maxsize=32)
def core_widths(name: str) -> dict[str, float]:
    """Character -> width; what has an accent is as wide as without."""
    if name.startswith("Courier"):
        return {}
    if name in _OWN_WIDTHS:
        found: dict[str, float] = {}
        for first, said in zip((0x20, 0xA1), _OWN_WIDTHS[name], strict=True):
            code = first
            for word in said.split():
                times, _, w = word.rpartition("*")
                for _ in range(int(times or 1)):
                    if c := (SYMBOL if name == "Symbol" else DINGBATS).get(code):
                        found.setdefault(c, float(w))
                    code += 1
            assert code == (0x7F if first == 0x20 else 0xFF), (name, hex(code))
        return found
    base = name.replace("Helvetica-Oblique", "Helvetica").replace("Helvetica-BoldOblique", "Helvetica-Bold")
    if base not in _WIDTHS:
        return {}
    row: list[float] = []
    for word in _WIDTHS[base].split():
        sign, _, times = word.partition("*")
        row += [float(_TEN.get(sign, sign))] * int(times or 1)
    out = {chr(32 + i): w for i, w in enumerate(row)}
    family = "H" if base[0] == "H" else "T"
    for c, w in _MORE.items():
        out[c] = float(w[family] if isinstance(w, dict) else w)
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFD", chr(code))[0]
        if plain != chr(code) and plain in out:
            out.setdefault(chr(code), out[plain])
    return out


def core_shape(name: str) -> tuple[float, float, tuple[float, float, float, float]]:
    return _SHAPES[name]

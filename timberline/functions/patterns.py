"""Regular expression pieces shared by the text functions.

Log patterns are written in the Unicode-aware Python dialect.  The JVM reads ``\\w``, ``\\d``
and ``\\s`` as ASCII and ``\\b`` differently per JDK release, so they are spelled out.
"""

WILDCARD = "<*>"
WORD = r"\p{L}\p{N}_"
NON_WORD_RUN = rf"[^{WORD}]+"
DIGIT = r"\p{Nd}"
# fixed values: the code points stripped by a Unicode-aware strip()
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LEADING_SPACE = rf"^[{SPACE}]+"
OUTER_SPACE = rf"^[{SPACE}]+|[{SPACE}]+$"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

_CLASS_MEMBERS = {"w": WORD, "d": DIGIT, "s": SPACE}
_NEGATED = {"W": WORD, "D": DIGIT, "S": SPACE}

# fixed values: the masking presets of the two public data sets
CORE_ID = r"core\.\d+"
IPV4 = r"(\d+\.){3}\d+"
HEX_WORD = r"\b(0x)?[0-9a-fA-F]+\b"
NUMBER = r"\d+(?:\.\d+)?"
FILE_PATH = r"\/[a-zA-Z0-9_:\-\.\/]+"

MASK_PRESETS = {
    "BGL": [CORE_ID, IPV4, HEX_WORD, NUMBER],
    "Thunderbird": [CORE_ID, IPV4, HEX_WORD, NUMBER, FILE_PATH],
    "Industry": [],
}


def jvm_pattern(pattern: str) -> str:
    """Spell out the Unicode classes of a Python pattern for the JVM regex engine."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in _CLASS_MEMBERS:
                members = _CLASS_MEMBERS[nxt]
                out.append(members if in_class else f"[{members}]")
            elif nxt in _NEGATED:
                out.append(f"[^{_NEGATED[nxt]}]")
            elif nxt == "b" and not in_class:
                out.append(BOUNDARY)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)

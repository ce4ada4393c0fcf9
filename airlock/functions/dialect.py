"""Patterns in JavaScript's dialect, for engines that read the same signs otherwise.

Catalogues of patterns are written for browsers. There, white space includes the no-break space and
other signs beyond ASCII, `$` is the very end of the text, `.` stops at four line ends only, `[` is
literal in a class, and a letter that means nothing after a backslash means itself. `translated` says
the same in the dialect of Java, which Spark's functions take, or of RE2.
"""

from __future__ import annotations

from functools import lru_cache

# The signs that JavaScript counts as white space and as line ends, as code points.
_SPACES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_LINE_ENDS = ((0x0A, 0x0A), (0x0D, 0x0D), (0x2028, 0x2029))
_WORD = "A-Za-z0-9_"
#: Escapes that mean the same everywhere.
_SHARED = set("dDwWnrtf") | set(".*+?^$|()[]{}/\\-'\"!#%&,:;<=>@`~ ")


def _range(a: int, b: int, to: str) -> str:
    sign = (lambda c: f"\\x{{{c:X}}}") if to == "re2" else (lambda c: f"\\u{c:04X}")
    return sign(a) if a == b else f"{sign(a)}-{sign(b)}"


def _outside(spans: tuple[tuple[int, int], ...]) -> list[tuple[int, int]]:
    """The code points that are in none of the spans."""
    edges = [0, *(x for a, b in spans for x in (a, b + 1)), 0x110000]
    return [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def _members(spans, to: str) -> str:
    if to == "java":
        return "".join(_range(a, b, to) if b <= 0xFFFF else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)
    return "".join(_range(a, b, to) for a, b in spans)


@lru_cache(maxsize=1024)
def translated(pattern: str, to: str = "java") -> str:
    """A JavaScript pattern, which may begin with its flags as (?i) or (?im), in Java's dialect or RE2's.

    Not translated: lookbehind without a greatest length (Java has none), any lookaround and back
    reference for RE2, and letters beyond ASCII that differ in case only. What JavaScript itself rejects
    may pass.
    """
    if to not in ("java", "re2"):
        raise ValueError(f"no dialect {to}")
    flags, at = "", 0
    if pattern.startswith("(?") and (end := pattern.find(")")) > 2 and pattern[2:end].isalpha():
        flags, at = pattern[2:end], end + 1
    lines = "m" in flags
    out, n = [f"(?{kept})"] if (kept := "".join(f for f in flags if f == "i")) else [], len(pattern)
    inside = False  # a class
    while at < n:
        c = pattern[at]
        if c == "\\" and at + 1 < n:
            piece, at = _escape(pattern, at, inside, to)
            out.append(piece)
            continue
        at += 1
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&~" else c)
        elif c == "[":
            if pattern.startswith("]", at):
                out.append("(?!)" if to == "java" else "[^\\x{0}-\\x{10FFFF}]")
                at += 1
            elif pattern.startswith("^]", at):
                out.append("(?s:.)")
                at += 2
            else:
                inside = True
                out.append("[")
                if pattern.startswith("^", at):
                    out.append("^")
                    at += 1
        elif c == ".":
            out.append("(?s:.)" if "s" in flags else f"[{_members(_outside(_LINE_ENDS), to)}]")
        elif c == "$":
            ends = _members(_LINE_ENDS, to)
            out.append((f"(?=[{ends}]|\\z)" if to == "java" else "(?m:$)") if lines else "\\z")
        elif c == "^" and lines:
            out.append(f"(?<=\\A|[{_members(_LINE_ENDS, to)}])" if to == "java" else "(?m:^)")
        elif c == "{" and not _counts(pattern, at):
            out.append("\\{")
        else:
            out.append(c)
    return "".join(out)


def _counts(pattern: str, at: int) -> bool:
    """If what follows an opening brace makes it a quantifier."""
    body, sep, _ = pattern[at:].partition("}")
    low, comma, high = body.partition(",")
    return bool(sep) and low.isdigit() and (not comma or not high or high.isdigit())


def _escape(pattern: str, at: int, inside: bool, to: str) -> tuple[str, int]:
    """The translation of the escape at a place, and where it ends."""
    c, after = pattern[at + 1], at + 2
    if c in "sS":
        spans = _SPACES if c == "s" else _outside(_SPACES)
        members = _members(spans, to)
        return (members if inside else f"[{members}]"), after
    if c in "bB" and not inside:
        if to == "re2":
            return f"\\{c}", after
        edge = f"(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}])"
        return (f"(?:{edge})" if c == "b" else f"(?!{edge})"), after
    if c == "b":
        return "\\x08", after
    if c == "v":
        return "\\x0B", after
    if c == "0":
        return "\\x00", after
    if c == "x" and _hex(pattern, after, 2):
        return pattern[at : after + 2], after + 2
    if c == "u" and _hex(pattern, after, 4):
        code = int(pattern[after : after + 4], 16)
        return (f"\\x{{{code:X}}}" if to == "re2" else f"\\u{code:04X}"), after + 4
    if c == "c" and after < len(pattern) and pattern[after].isascii() and pattern[after].isalpha():
        return f"\\x{ord(pattern[after]) % 32:02X}", after + 1
    if c == "k" and pattern.startswith("<", after) or c.isdigit():
        return f"\\{c}", after
    if c in _SHARED:
        return (f"\\{c}" if c not in "/ '\"!%,:;<=>@`" else c), after
    return c, after  # a letter that means itself


def _hex(pattern: str, at: int, many: int) -> bool:
    return len(digits := pattern[at : at + many]) == many and all(d in "0123456789abcdefABCDEF" for d in digits)

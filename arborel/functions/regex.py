"""XSD/XPath regular expressions as Java ones."""

from __future__ import annotations

import re

from ..errors import error

# Multi-character escapes of XSD that Java has not.
ESCAPES = {"i": r"\p{L}_:", "c": r"\p{L}\p{N}_:.\-\u00B7\p{M}", "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{S}", "s": r" \t\n\r"}


def _escape(c: str, inside: bool) -> str:
    low = c.lower()
    body = ESCAPES[low]
    if c == low:
        return body if inside else f"[{body}]"
    return f"[^{body}]"  # in a class, a member of its union


def translate(pattern: str, flags: str = "") -> str:
    """The Java pattern of an XPath one; class subtraction becomes an intersection."""
    bad = set(flags) - set("smixq")
    if bad:
        raise error("FORX0001", f"invalid flags {flags!r}")
    own = "".join(f for f in flags if f in "smi")
    prefix = f"(?{own}{'u' if 'i' in own else ''})" if own else ""
    if "q" in flags:
        return prefix.replace("s", "").replace("m", "") + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", pattern)
    out: list[str] = []
    depth, i, n = 0, 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise error("FORX0002", "pattern ends with a backslash")
            e = pattern[i + 1]
            if e in "pP" and pattern[i + 2 : i + 3] == "{":
                end = pattern.find("}", i)
                name = pattern[i + 3 : end]
                out.append(f"\\{e}{{{'In' + name[2:] if name.startswith('Is') else name}}}")
                i = end + 1
                continue
            if e.lower() in ESCAPES:
                out.append(_escape(e, depth > 0))
            elif e.isdigit() or e in "nrt\\|.?*+(){}-[]^$":
                out.append("\\" + e)
            else:
                raise error("FORX0002", f"invalid escape \\{e}")
            i += 2
            continue
        if c == "[":
            if depth and out and out[-1] == "-":
                out[-1] = "&&[^"
                i += 1
                if pattern[i : i + 1] == "^":
                    out[-1] = "&&["
                    i += 1
                depth += 1
                continue
            if depth:
                raise error("FORX0002", "'[' in a character class")
            depth += 1
        elif c == "]":
            if not depth:
                raise error("FORX0002", "unbalanced ']'")
            depth -= 1
        elif "x" in flags and c in " \t\n\r" and not depth:
            i += 1
            continue
        elif c == "$" and not depth and "m" not in flags:
            out.append(r"\z")
            i += 1
            continue
        elif c == "." and not depth and "s" not in flags:
            out.append(r"[^\n\r]")
            i += 1
            continue
        elif depth and c == "&":
            out.append(r"\&")
            i += 1
            continue
        out.append(c)
        i += 1
    if depth:
        raise error("FORX0002", "character class is not closed")
    return prefix + "".join(out)


def matches_empty(pattern: str, flags: str = "") -> bool:
    """Whether a pattern matches the empty string, by its ASCII reading."""
    plain = re.sub(r"\\[pPicIC](\{[^}]*\})?", "x", pattern)
    try:
        return re.search(re.escape(plain) if "q" in flags else plain, "") is not None
    except re.error:
        return False


def replacement(text: str, flags: str = "") -> str:
    """The Java replacement of an XPath one."""
    if "q" in flags:
        return text.replace("\\", "\\\\").replace("$", "\\$")
    if re.search(r"\\(?![\\$])|(?<!\\)(?:\\\\)*\$(?!\d)", text):
        raise error("FORX0004", f"invalid replacement {text!r}")
    return text

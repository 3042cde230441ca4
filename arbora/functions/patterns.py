"""Patterns of other dialects as Java regular expressions; made on the driver, matched by Spark."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """A shell pattern: * and ? stop at /, ** crosses it, [..] is a class. A malformed one matches nothing."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob[i : i + 3] == "**/":
                out.append("(?:.*/)?")
                i += 3
                continue
            if glob[i : i + 2] == "**":
                out.append(".*")
                i += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return r"(?!)"
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def re2_to_java(pattern: str, ignore_case: bool = False) -> str:
    """An RE2 pattern for java.util.regex: line ends mean \\n only, a final $ is the very end, case folding is Unicode's.

    Raises ValueError for what RE2 has not (look-around, back references, possessive quantifiers) or means otherwise.
    """
    if re.search(r"\(\?(?:[=!]|<[=!]|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or re.search(r"[*+?}]\+", pattern) or re.search(r"\(\?[a-zA-Z]*U", pattern):
        raise ValueError(f"not a pattern of this dialect: {pattern}")
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    if not multiline and re.search(r"(?<!\\)(?:\\\\)*\$$", pattern):
        pattern = pattern[:-1] + r"\z"
    return ("(?diu)" if ignore_case else "(?d)") + pattern

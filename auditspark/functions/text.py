"""Pattern helpers: globs, literal LIKE text and the RE2 subset of Java regex."""

from __future__ import annotations

import re

from pyspark import SparkContext

MAX_PATTERN_BYTES = 4096

# Constructs Java accepts and RE2 does not.
_NOT_RE2 = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k[<{]|\\G|\\Z|\\R|\\X|[*+?}]\+")
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit",
    "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}


def like_literal(text: str) -> str:
    """Escape LIKE metacharacters (escape character is a backslash)."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def glob_to_like(glob: str) -> str:
    return like_literal(glob).replace("*", "%").replace("?", "_")


def _outside_class(pattern: str):
    """Yield (position, in_class, token); a token is one character or an escape pair."""
    i, depth = 0, False
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "[" and not depth:
            depth = True
            yield i, False, token
            i += 1
            if pattern[i:i + 1] == "^":
                yield i, True, "^"
                i += 1
            if pattern[i:i + 1] == "]":  # a leading ] is a literal
                yield i, True, "\\]"
                i += 1
            continue
        posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:]) if depth else None
        if posix and posix.group(2) in _POSIX:
            yield i, True, ("\\P" if posix.group(1) else "\\p") + "{" + _POSIX[posix.group(2)] + "}"
            i += posix.end()
            continue
        if depth and token == "]":
            depth = False
            yield i, False, token
        elif depth and token in ("[", "&"):  # Java would read a union or intersection
            yield i, True, "\\" + token
        else:
            yield i, depth, token
        i += len(token)


def java_regex(pattern: str, ignore_case: bool = True) -> str:
    """Check an RE2 pattern on the driver and spell it for Spark's ``rlike``.

    Raises ``ValueError`` even when the data is empty.  ``$`` means end of text
    (Java would also match before a final newline) and ``.`` excludes ``\\n`` only.
    """
    if len(pattern.encode("utf-8")) > MAX_PATTERN_BYTES:
        raise ValueError("regular expression exceeds 4096 bytes")
    tokens = list(_outside_class(pattern))
    skeleton = "".join("." if inside else token for _, inside, token in tokens if token not in ("\\\\",))
    if _NOT_RE2.search(skeleton):
        raise ValueError("regular expression uses constructs outside RE2")
    multiline = re.search(r"\(\?[a-zA-Z]*m", skeleton) is not None
    body = "".join("\\z" if token == "$" and not inside and not multiline else token for _, inside, token in tokens)
    body = body.replace("(?P<", "(?<")
    spelled = ("(?iud)" if ignore_case else "(?d)") + body
    context = SparkContext._active_spark_context
    try:
        if context is not None:
            context._jvm.java.util.regex.Pattern.compile(spelled)
        else:
            re.compile(pattern)
    except Exception as error:
        raise ValueError(f"invalid regular expression: {pattern!r}") from error
    return spelled

"""Writing down R/ICU regular expressions for Spark's Java engine.

ICU knows POSIX classes such as ``[:punct:]`` outside brackets; Java reads
the same text as a bracket of the letters ``:punct`` and silently corrupts
text. Unicode-aware ``\\w \\b \\d`` need the ``(?U)`` flag in Java.
"""

from __future__ import annotations

# POSIX class names and the Java classes that mean the same.
# [:punct:] -> \p{P} (punctuation only; \p{Punct} would also take $ and +)
POSIX_CLASSES = {
    "[:punct:]": r"\p{P}",
    "[:symbol:]": r"\p{S}",
    "[:alpha:]": r"\p{L}",
    "[:digit:]": r"\d",
    "[:space:]": r"\s",
    "[:upper:]": r"\p{Lu}",
    "[:lower:]": r"\p{Ll}",
    "[:alnum:]": r"[\p{L}\p{Nd}]",
}


def java_regex(pattern: str, unicode: bool = True) -> str:
    r"""Translate POSIX class names and turn on Unicode classes.

    The patterns come from R, whose ICU engine treats ``\w \W \b \d \s``
    as Unicode classes: ``é`` is a word character there, while plain Java
    would strip it with ``^\W+``. ``(?U)`` gives Java the ICU meaning.
    """
    out = pattern
    for posix, java in POSIX_CLASSES.items():
        out = out.replace(posix, java)
    if unicode and not out.startswith("(?U)"):
        out = "(?U)" + out
    return out


def alternation(patterns, wrap: bool = True) -> str:
    """Join patterns into one alternation (R ``str_flatten(collapse = "|")``).

    Each alternative is wrapped in a non-capturing group so an anchor or a
    trailing quantifier in one cannot leak into the next.
    """
    parts = [f"(?:{p})" if wrap else p for p in patterns]
    return "|".join(parts)


_FIRST_CACHE: dict[str, str] = {}


def first_char_prefilter(spark, pattern: str) -> str:
    """The same regular expression, prefixed with a look-ahead on the
    characters a match can start with.

    Java tries every alternative of a long alternation at every position of
    the text; the look-ahead rejects most positions with one class test.
    It cannot change any match: a position is skipped only when Java's own
    matcher, asked at plan time with ``lookingAt``/``hitEnd`` and several
    preceding characters (none, a letter, a space, a non-ASCII letter, a
    digit), shows that no match can start with that character. Every
    non-ASCII character is kept as possible. Patterns with look-behind are
    returned unchanged, as are patterns any ASCII character can start.
    """
    if "(?<" in pattern:
        return pattern
    if pattern in _FIRST_CACHE:
        return _FIRST_CACHE[pattern]
    jvm = spark._jvm
    compiled = jvm.java.util.regex.Pattern.compile(pattern)
    possible = []
    for code in range(128):
        c = chr(code)
        for ctx in ("", "a", " ", "é", "1"):
            s = ctx + c
            m = compiled.matcher(s)
            m.useTransparentBounds(True)
            m.useAnchoringBounds(False)
            m.region(len(ctx), len(s))
            if m.lookingAt() or m.hitEnd():
                possible.append(code)
                break
    if len(possible) == 128:
        out = pattern
    else:
        flags = "(?U)" if pattern.startswith("(?U)") else ""
        body = pattern[len(flags):]
        klass = "".join(f"\\x{{{c:02x}}}" for c in possible) + "\\x{80}-\\x{10ffff}"
        out = f"{flags}(?=[{klass}])(?:{body})"
    _FIRST_CACHE[pattern] = out
    return out


class _Parts:
    """Reads a pattern of the tables' syntax and finds literals that every
    match must hold. Anything not understood counts as unknown text."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def branches(self):
        """Any-of literals of an alternation, None if a branch has none."""
        found = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            found.append(self.sequence())
        return None if any(f is None for f in found) else frozenset().union(*found)

    def sequence(self):
        sets, run = [], ""
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            kind, value = self.item()
            low, more = self.count()
            if kind == "char" and low:
                run += value
                if not more:
                    continue
            elif kind == "nothing":
                continue
            elif kind == "group" and low and value:
                sets.append(value)
            # what follows need not touch what stood before
            sets.append(frozenset([run]) if run else None)
            run = ""
        sets.append(frozenset([run]) if run else None)
        known = [x for x in sets if x]
        return max(known, key=lambda x: (min(map(len, x)), -len(x))) if known else None

    def item(self):
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            look = self.p.startswith("?", self.i) and not self.p.startswith("?:", self.i)
            if self.p[self.i:self.i + 1] == "?":
                while self.p[self.i] in "?:=!<":
                    self.i += 1
            inner = self.branches()
            self.i += 1
            return ("unknown", None) if look else ("group", inner)
        if c == "[":
            depth = 1
            while depth:
                c = self.p[self.i]
                depth += (c == "[") - (c == "]")
                self.i += 1 + (c == "\\")
            return "unknown", None
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "b":
                return "nothing", None
            return ("unknown", None) if c.isalnum() else ("char", c)
        return ("unknown", None) if c in ".^$" else ("char", c)

    def count(self):
        """(whether it must occur, whether it may occur more than once)."""
        c = self.p[self.i:self.i + 1]
        if c and c in "?*+":
            self.i += 1
            return c == "+", c != "?"
        if c == "{":
            end = self.p.index("}", self.i)
            low = self.p[self.i + 1:end].split(",")[0]
            self.i = end + 1
            return low not in ("", "0"), True
        return True, False


def required_literals(pattern: str) -> frozenset[str] | None:
    """Literals of which every match of the pattern holds at least one; None
    if there is no such set. Used to skip texts that cannot match."""
    reader = _Parts(pattern)
    found = reader.branches()
    return found if reader.i == len(pattern) else None


# Longest prefix looked at: the scan of the status tags takes 1.5 s with 3
# characters, 1.2 s with 8 and with 12, whose look-ahead is four times as long.
PREFIX_CHARS = 8


class _Starts(_Parts):
    """Reads a pattern of the tables' syntax and finds strings of which each
    match starts with one. A string is open if what follows it in the pattern
    is known, closed if anything may follow."""

    def __init__(self, pattern: str, k: int):
        super().__init__(pattern)
        self.k = k

    def branches(self):
        found = set(self.sequence())
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            found |= self.sequence()
        return found

    def sequence(self):
        done = {("", True)}
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            one = self.item()
            low, more = self.count()
            if more:
                one = {(s, False) for s, _ in one}
            if not low:
                one = one | {("", True)}
            done = {x for s, is_open in done for x in (self.follow(s, one) if is_open else [(s, False)])}
        return done

    def follow(self, s, one):
        return {((s + t)[:self.k], is_open and len(s + t) < self.k) for t, is_open in one}

    def item(self):
        start = self.i
        c = self.p[start]
        if c == "[":
            super().item()
            inner = self.p[start + 1:self.i - 1]
            return {(x, True) for x in inner} if inner.isalnum() and inner.isascii() else {("", False)}
        kind, value = super().item()
        if kind == "group":
            return value
        if kind == "char":
            return {(value, True)}
        # an assertion takes no text; leaving it out only lets more through
        nothing = kind == "nothing" or c in "^$" or self.p.startswith("(?", start)
        return {("", nothing)}


def match_starts(pattern: str, k: int = PREFIX_CHARS) -> set[str] | None:
    """Strings of at most ``k`` characters, none a prefix of another, of which
    every match starts with one; None if a match may start with anything."""
    if "(?i" in pattern:
        return None
    reader = _Starts(pattern, k)
    found = sorted({s for s, _ in reader.branches()})
    if reader.i != len(pattern) or not found or "" in found:
        return None
    kept = [found[0]]
    for s in found[1:]:
        if not s.startswith(kept[-1]):
            kept.append(s)
    return set(kept)


def _trie(strings) -> str:
    """The strings as one regular expression, shared beginnings written once."""
    by_first: dict[str, list[str]] = {}
    for s in sorted(strings):
        by_first.setdefault(s[0], []).append(s[1:])
    parts = []
    for c, rest in by_first.items():
        head = f"\\x{{{ord(c):x}}}"
        parts.append(head if "" in rest else head + _trie(rest))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def prefix_prefilter(pattern: str) -> str:
    """The same regular expression behind a look-ahead on how its matches
    start (:func:`match_starts`): the alternatives are tried only where the
    text goes on like the start of one of them, which no match can miss.
    Unchanged if a match may start with anything."""
    flags = "(?U)" if pattern.startswith("(?U)") else ""
    body = pattern[len(flags):]
    starts = match_starts(body)
    if not starts:
        return pattern
    # one class test first: Java tries the branches of the trie one after another
    klass = "".join(f"\\x{{{ord(c):x}}}" for c in sorted({s[0] for s in starts}))
    return f"{flags}(?=[{klass}])(?={_trie(starts)})(?:{body})"

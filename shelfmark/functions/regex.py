"""Regular expressions of a linear-time dialect (no look-around, no back-references) as Java's, which Spark runs.

A recursive descent over the pattern gives Java text with the same meaning: `$` is the end of the text unless `m` holds, `.`
stops at \\n alone, named groups lose their names, POSIX and Unicode classes, set operations, swapped greed and verbose mode
are spelled out, a second quantifier repeats the first one's result. What the dialect lacks is an error before any query.

Beside the Java text each part of the pattern tells what it needs: the one text that it stands for, if it does, and sets of
texts of which every match holds one, folded to lower case. A sequence needs all that its parts need, its literals joined; of
alternatives each gives its set of longest texts, and their union is needed; what may be absent needs nothing."""

from __future__ import annotations

import re


class RegexError(ValueError):
    pass


#: POSIX classes (fixed values), ASCII as in the dialect.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": "\\x00-\\x7F", "blank": "\\t\\x20", "cntrl": "\\x00-\\x1F\\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": "\\x20-~", "punct": "!-/:-@\\[-`{-~", "space": "\\t\\n\\x0B\\f\\r\\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Long names of general categories (fixed values).
CATEGORIES = {
    "letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm",
    "otherletter": "Lo", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No", "connectorpunctuation": "Pc", "dashpunctuation": "Pd",
    "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk",
    "othersymbol": "So", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "control": "Cc", "format": "Cf", "privateuse": "Co", "unassigned": "Cn",
}
_SHORT = {"L", "M", "N", "P", "S", "Z", "C", *CATEGORIES.values()}
_ESCAPES = {"a": 0x07, "f": 0x0C, "t": 0x09, "n": 0x0A, "r": 0x0D, "v": 0x0B}


def literal(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and (c.isalnum() or c == "_") else f"\\x{{{code:X}}}"


#: The one text that a part stands for, or None, and the sets of texts of which a match holds one each.
Need = tuple[str | None, list[frozenset[str]]]
NOTHING: Need = (None, [])
EMPTY: Need = ("", [])
#: Alternatives that are told one by one; of more, none is needed.
MOST = 64


def _text(java: str) -> Need:
    """Of a literal's Java text. Letters outside ASCII have several lower cases, and so need nothing."""
    code = int(java[3:-1], 16) if java.startswith("\\x{") else ord(java)
    return (chr(code).lower(), [frozenset(chr(code).lower())]) if code < 128 else NOTHING


def _sequence(parts: list[Need]) -> Need:
    needs, run, whole = [], "", True
    for text, own in parts:
        if text is None:
            needs += [frozenset((run,))] * bool(run) + own
            run, whole = "", False
        else:
            run += text
    return run if whole else None, needs + [frozenset((run,))] * bool(run)


def _either(branches: list[Need]) -> Need:
    if len(branches) == 1:
        return branches[0]
    if not all(needs for _, needs in branches):
        return NOTHING
    texts = frozenset().union(*(max(needs, key=lambda x: min(map(len, x))) for _, needs in branches))
    return (None, [texts]) if len(texts) <= MOST else NOTHING


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at, self.depth, self.names, self.need = pattern, 0, 0, set(), EMPTY
        self.flags = {"m": False, "s": False, "i": False, "x": False, "U": False}

    def fail(self, what: str):
        raise RegexError(f"{what} at {self.at} of {self.text!r}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, expected: str = "") -> str:
        c = self.peek(len(expected) or 1)
        if not c or expected and c != expected:
            self.fail(f"expected {expected or 'more'}")
        self.at += len(c)
        return c

    def until(self, end: str) -> str:
        to = self.text.find(end, self.at)
        if to < 0:
            self.fail(f"no {end}")
        found, self.at = self.text[self.at : to], to + len(end)
        return found

    def skip(self) -> None:
        while self.flags["x"] and self.peek() and (self.peek().isspace() or self.peek() == "#"):
            if self.take() == "#":
                while self.peek() and self.take() != "\n":
                    pass

    def alternation(self) -> str:
        out, branches, parts = [], [], []
        while True:
            self.skip()
            c = self.peek()
            if not c or c == ")":
                self.need = _either([*branches, _sequence(parts)])
                return "".join(out)
            if c == "|":
                out.append(self.take())
                branches.append(_sequence(parts))
                parts = []
            else:
                out.append(self.repeated())
                parts.append(self.need)

    def repeated(self) -> str:
        begin = self.at
        atom, times = self.atom(), 0
        bare = self.text[begin : begin + 2] == "(?" and ":" not in self.text[begin : self.at] and "<" not in self.text[begin : self.at]  # flags alone
        while True:
            self.skip()
            c = self.peek()
            if c == "" or c not in "*+?{":
                return atom
            if bare:
                self.fail("nothing to repeat")
            self.at += 1
            least = int(c == "+")
            if c == "{":
                low, comma, high = self.until("}").replace(" ", "").partition(",")
                if not (low + high).isdecimal() or low and high and int(low) > int(high):
                    self.fail("repetition")
                c, least = "{" + (low or "0") + comma + high + "}", int(low or 0)
            self.need = (None, self.need[1]) if least else NOTHING
            lazy = self.peek() == "?"
            self.at += lazy
            atom = (f"(?:{atom})" if times else atom) + c + ("?" if lazy != self.flags["U"] else "")
            times += 1

    def atom(self) -> str:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            out = self.set_()
            only = re.fullmatch(r"\[(\w|\\x\{[0-9A-F]+\})\]", out, re.ASCII)
            self.need = _text(only[1]) if only else NOTHING
            return out
        if c == "\\":
            out = self.escape(inside=False)
            self.need = _text(out) if len(out) == 1 or out.startswith("\\x{") else EMPTY if out[1] in "AzbB" else NOTHING
            return out
        if c in "$^":
            self.need = EMPTY
            return "\\z" if c == "$" and not self.flags["m"] else c
        if c == ".":
            self.need = NOTHING
            return c
        if c in "*+?{":
            self.fail("nothing to repeat")
        out = literal(ord(c))
        self.need = _text(out)
        return out

    def group(self) -> str:
        kept = dict(self.flags)
        out = "(?:"
        if self.peek() == "?":
            self.at += 1
            if self.peek() in ("=", "!") or self.peek(2) in ("<=", "<!"):
                self.fail("look-around is not supported")
            if self.peek() == "<" or self.peek(2) == "P<":
                self.until("<")
                name = self.until(">")
                if not name or name in self.names or not (name[0].isalpha() or name[0] == "_"):
                    self.fail("group name")
                self.names.add(name)
            else:
                on, java = True, ["", ""]
                while (c := self.take()) not in ":)":
                    if c == "-" and on:
                        on = False
                    elif c in self.flags:
                        self.flags[c] = on
                        java[not on] += c if c in "msi" else ""
                    elif not (c == "u" and on):
                        self.fail(f"flag {c}")
                shown = f"(?{java[0]}" + (f"-{java[1]}" if java[1] else "")
                if c == ")":
                    self.need = EMPTY
                    return shown + ")" if len(shown) > 2 else ""
                out = shown + ":"
        inner = self.alternation()
        self.take(")")
        self.flags = kept
        return out + inner + ")"

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in "dDsSwW":
            return "\\" + c
        if c in "pP":
            return self.category(c)
        if c in "xuU":
            if self.peek() == "{":
                self.at += 1
                digits = self.until("}")
            else:
                n = {"x": 2, "u": 4, "U": 8}[c]
                digits, self.at = self.peek(n), self.at + n
            try:
                return literal(int(digits, 16))
            except (ValueError, OverflowError):
                self.fail("code point")
        if c in _ESCAPES:
            return literal(_ESCAPES[c])
        if not inside:
            if c == "b" and self.peek() == "{":
                self.at += 1
                c = {"start": "<", "end": ">"}.get(self.until("}")) or self.fail("word boundary")
            if c in "AzbB":
                return "\\" + c
            if c in "<>":
                return "\\b(?=\\w)" if c == "<" else "\\b(?<=\\w)"
        if c.isalnum() or not c.isascii():
            self.fail("back-references are not supported" if c.isdecimal() else f"escape \\{c}")
        return literal(ord(c))

    def category(self, kind: str) -> str:
        name = self.take()
        if name == "{":
            name = self.until("}")
        negated = (kind == "P") != name.startswith("^")
        name = name.removeprefix("^")
        key, _, value = name.partition("=") if "=" in name else ("", "", name)
        plain = value.replace("_", "").replace(" ", "").replace("-", "").lower()
        if key.lower() in ("", "gc", "general_category", "generalcategory") and (value in _SHORT or plain in CATEGORIES):
            name = value if value in _SHORT else CATEGORIES[plain]
        elif plain == "any":
            return "[^\\x{0}-\\x{10FFFF}]" if negated else "[\\x{0}-\\x{10FFFF}]"
        elif key.lower() in ("", "sc", "script", "scx") and value:
            name = "Is" + value.replace(" ", "_")
        else:
            self.fail(f"class {name}")
        return f"\\{'P' if negated else 'p'}{{{name}}}"

    def set_(self) -> str:
        """A bracketed set, with nested sets and the operations &&, -- and ~~, which bind less than juxtaposition."""
        negated = self.peek() == "^"
        self.at += negated
        done, op, items = "", "", []

        def joined() -> str:
            own = "[" + "".join(items) + "]" if items else self.fail("empty set")
            return own if not op else {"&&": f"[{done}&&{own}]", "--": f"[{done}&&[^{own}]]", "~~": f"[[{done}{own}]&&[^[{done}&&{own}]]]"}[op]

        first = True
        while True:
            if self.peek() == "]" and not first:
                self.at += 1
                break
            first = False
            if self.peek(2) in ("&&", "--", "~~"):
                done, op, items = joined(), self.take(self.peek(2)), []
                continue
            if self.peek(2) == "[:":
                self.at += 2
                name = self.until(":]")
                ranges = POSIX.get(name.removeprefix("^")) or self.fail(f"class {name}")
                items.append(f"[^{ranges}]" if name.startswith("^") else f"[{ranges}]")
                continue
            c = self.take()
            if c == "[":
                items.append(self.set_())
                continue
            if self.flags["x"] and c.isspace():
                continue
            low = self.escape(inside=True) if c == "\\" else literal(ord(c))
            if self.peek() == "-" and self.peek(2) not in ("--", "-]") and self.peek(2) != "-":
                self.at += 1
                c = self.take()
                high = self.escape(inside=True) if c == "\\" else literal(ord(c))
                if any(len(x) > 1 and not x.startswith("\\x{") for x in (low, high)) or self._code(low) > self._code(high):
                    self.fail("range")
                low = f"{low}-{high}"
            items.append(low)
        inner = joined()
        return f"[^{inner}]" if negated else inner

    @staticmethod
    def _code(x: str) -> int:
        return int(x[3:-1], 16) if x.startswith("\\x{") else ord(x)


def parse(pattern: str, case_sensitive: bool = False) -> tuple[str, list[frozenset[str]]]:
    """The Java pattern that finds what `pattern` finds, and the sets of texts of which all that it finds holds one each,
    folded; RegexError where it is no pattern."""
    parser = _Parser(pattern)
    out = parser.alternation()
    if parser.at < len(pattern):
        parser.fail("unbalanced )")
    return ("(?dU)" if case_sensitive else "(?diU)") + out, parser.need[1]


def to_java(pattern: str, case_sensitive: bool = False) -> str:
    return parse(pattern, case_sensitive)[0]

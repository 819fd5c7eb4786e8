"""Flat grammars over token classes: the machinery of the parsers in ``syntax``.

A text becomes a string of one character per token. Brackets are reduced from the inside out: the content of a
pair, itself flat by then, is matched against every reading its bracket may have (a block, an object, a
parameter list ...), and the pair becomes one character that stands for the set of its readings. Each content is
judged once per worker, as the same few shapes fill most code, so a parse costs little more than its tokens.
A content without any reading, an unmatched bracket or an unknown character rejects the text.
"""

from __future__ import annotations

import regex as re

#: First code points of reduced pairs, by opening bracket, and of words and signs in the rules.
_BASE = {"(": 0xE000, "[": 0xE100, "{": 0xE200}
_WORDS = 0x4E00
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Contents longer than this are judged anew each time.
_MEMO_CHARS, _MEMO = 400, 1 << 17


class Grammar:
    """Rules of one language: ``'word'`` is a token, ``%NAME`` another rule or a reading, blanks mean nothing."""

    def __init__(self, readings: dict[str, list[str]], words: str, signs: str):
        self.readings = readings
        self.chars: dict[str, str] = {}
        for w in (words + " " + signs).split():
            self.chars.setdefault(w, chr(_WORDS + len(self.chars)))
        self.words = {w for w in words.split()}
        self.rules: dict[str, str] = {}
        self.defined: dict[str, str] = {}
        for bracket, names in readings.items():
            for bit, name in enumerate(names):
                self.rules[name] = "[" + "".join(chr(_BASE[bracket] + m) for m in range(1 << len(names)) if m >> bit & 1) + "]"
            self.rules[{"(": "ANYP", "[": "ANYK", "{": "ANYB"}[bracket]] = f"[{chr(_BASE[bracket])}-{chr(_BASE[bracket] + (1 << len(names)) - 1)}]"
        self.reduce: re.Pattern | None = None
        self.tests: dict[str, list[re.Pattern]] = {}
        self.memo: dict[tuple[str, str], int] = {}
        self.pieces: dict[str, re.Pattern] = {}
        self.piece_memo: dict[tuple[str, str], bool] = {}

    def rule(self, name: str, text: str) -> None:
        """A rule; beyond a few signs it is a subpattern that the others call."""
        body = self.expand(text)
        if len(body) > 60:
            self.defined[name] = body
            self.rules[name] = f"(?&{name})"
        else:
            self.rules[name] = f"(?:{body})"

    def expand(self, text: str) -> str:
        text = re.sub(r"'([^' ]+)'", lambda m: re.escape(self.chars[m.group(1)]), text)
        return re.sub(r"\s+", "", re.sub(r"%([A-Za-z_]+)", lambda m: self.rules[m.group(1)], text))

    def cls(self, name: str, words: str, plain: str = "") -> None:
        """A rule that is one token of several."""
        self.rules[name] = "[" + plain + "".join(re.escape(self.chars[w]) for w in words.split()) + "]"

    def finish(self, top: str) -> None:
        for bracket, names in self.readings.items():
            self.tests[bracket] = [self.compile(self.rules["in" + n]) for n in names]
        self.top = self.compile(self.rules[top])
        minus, comma = re.escape(self.chars["-"]), re.escape(self.chars[","])
        self.lists = re.compile(f"(?:{minus}?[ns]{comma})+({minus}?[ns]{comma})")

    def compile(self, pattern: str) -> re.Pattern:
        """A pattern with the subpatterns it calls, directly or not."""
        need, todo = [], [pattern]
        while todo:
            for n in re.findall(r"\(\?&(\w+)\)", todo.pop()):
                if n not in need:
                    need.append(n)
                    todo.append(self.defined[n])
        return re.compile("(?(DEFINE)" + "".join(f"(?P<{n}>{self.defined[n]})" for n in need) + ")" + pattern if need else pattern)

    def repeats(self, name: str, ends: str, groups: str = "") -> None:
        """A reading is a row of statements that all end in one of the tokens ``ends`` (or in a pair with a bracket of ``groups``).

        Such a content is judged statement by statement, as statements repeat more than blocks do; only if one of the
        pieces doesn't stand alone, the whole is. Pieces that stand alone also do in a row, so nothing wrong is accepted.
        """
        stop = "".join(re.escape(self.chars.get(e, e)) for e in ends.split()) + "".join(f"{chr(_BASE[b])}-{chr(_BASE[b] + 255)}" for b in groups)
        self.pieces[name] = re.compile(f"[^{stop}]*[{stop}]|[^{stop}]+")

    def matches(self, name: str, test: re.Pattern, content: str) -> bool:
        """Whether a reading takes a content, by its statements where it is a row of them."""
        cut = self.pieces.get(name)
        if cut is not None and len(content) > 12:
            memo = self.piece_memo
            if len(memo) >= _MEMO:
                memo.clear()
            for p in cut.findall(content):
                ok = memo.get((name, p))
                if ok is None:
                    ok = memo[name, p] = test.fullmatch(p) is not None
                if not ok:
                    break
            else:
                return True
        return test.fullmatch(content) is not None

    def judge(self, bracket: str, content: str) -> int:
        """Readings of a pair as a bit set; 0 rejects it."""
        key = (bracket, content)
        mask = self.memo.get(key)
        if mask is None:
            if len(content) > 200:  # a long list of plain literals is as valid as a short one
                content = self.lists.sub(r"\1", content)
            flat = self.flatten(content)
            mask = sum(1 << bit for bit, (n, t) in enumerate(zip(self.readings[bracket], self.tests[bracket], strict=True)) if self.matches(n, t, flat))
            if len(content) <= _MEMO_CHARS:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[key] = mask
        return mask

    def flatten(self, content: str) -> str:
        """Type arguments to one character each, from the inside out, where the language has them."""
        if self.reduce is None:
            return content
        while True:
            new = self.reduce.sub("Λ", content)
            if new == content:
                return content
            content = new

    def accepts(self, tokens: list[str]) -> bool:
        """Whether a list of token characters (brackets as themselves) is a text of the language."""
        stack: list[tuple[str, list[str]]] = []
        out: list[str] = []
        for t in tokens:
            if t in "([{":
                stack.append((t, out))
                out = []
            elif t in ")]}":
                if not stack or stack[-1][0] != _CLOSE[t]:
                    return False
                bracket, before = stack.pop()
                mask = self.judge(bracket, "".join(out))
                if not mask:
                    return False
                out = before
                out.append(chr(_BASE[bracket] + mask))
            else:
                out.append(t)
        return not stack and self.matches("", self.top, self.flatten("".join(out)))

"""Objects in growing texts: an incremental scanner that sees each character once, and what is made of it."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlane.functions.jsonfix import NOT_TEXT

# When a text without objects counts as a loop: a unit of so many characters, so many times at the end, of so many characters in all.
LEAST_UNIT, MOST_UNIT, REPEATS, LEAST_TOTAL = 24, 240, 3, 80
#: Characters of a number or word in an object, beyond which it can't be one.
TOKEN = 400
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = frozenset(("true", "false", "null", "NaN", "Infinity", "-Infinity"))
_BLANK, _PLAIN = " \t\n\r", frozenset("+-.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_AFTER_VALUE = {"{": "member", "[": "item"}


class Candidate:
    """An object that may have begun at `start`: a stack of open brackets and what may come next."""

    __slots__ = ("escape", "key", "start", "stack", "token", "want")

    def __init__(self, start: int, stack: str = "", want: str = "open", token: str = "", key: bool = False, escape: int = -1):
        self.start, self.stack, self.want, self.token, self.key, self.escape = start, stack, want, token, key, escape

    def dump(self) -> list:
        return [self.start, self.stack, self.want, self.token, self.key, self.escape]

    def feed(self, ch: str) -> bool | None:
        """True: complete with this character, False: no object, None: may still be one."""
        if self.want == "string":
            if self.escape > 0:  # digits of \\u
                self.escape -= 1
                return None if ch in "0123456789abcdefABCDEF" else False
            if self.escape == 0:
                self.escape = 4 if ch == "u" else -1
                if self.escape < 0 and ch not in '"\\/bfnrt':
                    return False
                return None
            if ch == "\\":
                self.escape = 0
            elif ch == '"':
                self.want = "colon" if self.key else _AFTER_VALUE[self.stack[-1]]
            elif ch < " ":
                return False
            return None
        if self.want == "token":
            if ch in _PLAIN and len(self.token) < TOKEN:
                self.token += ch
                return None
            if self.token not in _WORDS and not _NUMBER.fullmatch(self.token):
                return False
            self.token, self.want = "", _AFTER_VALUE[self.stack[-1]]
        if ch in _BLANK:
            return None
        if self.want in ("value", "first item") and ch not in "]}:,":
            if ch == '"':
                self.want, self.key = "string", False
            elif ch in "{[":
                self.stack += ch
                self.want = "first key" if ch == "{" else "first item"
            elif ch in _PLAIN:
                self.want, self.token = "token", ch
            else:
                return False
            return None
        if self.want == "open" and ch == "{":
            self.stack, self.want = "{", "first key"
        elif self.want in ("first key", "key") and ch == '"':
            self.want, self.key = "string", True
        elif self.want == "colon" and ch == ":":
            self.want = "value"
        elif self.want in ("member", "item") and ch == ",":
            self.want = "key" if self.want == "member" else "value"
        elif self.want in ("member", "first key") and ch == "}" or self.want in ("item", "first item") and ch == "]":
            self.stack = self.stack[:-1]
            if not self.stack:
                return True
            self.want = _AFTER_VALUE[self.stack[-1]]
        else:
            return False
        return None


def first_value(obj) -> object:
    """The first scalar of an object that is no blank text: detected_text and text before others, NOT_TEXT never; else None."""
    good = lambda v: isinstance(v, str) and bool(v.strip()) or isinstance(v, (int, float))
    named = [obj[k] for k in ("detected_text", "text") if k in obj and good(obj[k])]
    return next(iter([*named, *(v for k, v in obj.items() if k not in NOT_TEXT and good(v))]), None)


def parsed_object(text: str) -> dict | None:
    try:
        obj = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return obj if isinstance(obj, dict) else None


def holds_text(text: str) -> bool:
    obj = parsed_object(text)
    return obj is not None and first_value(obj) is not None


# Shapes of a broken object of one member, and of a label with its value.
BROKEN = (r'\{\s*"[^"]+?"\s*:?\s*"([^"]+)"\s*\}\s*', r'\{\s*"[^"]+?:\s*"\s*([^"}]+)"?\s*\}\s*', r'\{\s*"[^"]+?"\s*:?\s*([^"}][^}]*)\s*\}\s*')
LABELLED = r"[A-Za-z][^:\n]{0,80}?\s*:\s*([^\n{}]+)\s*"
QUOTES = str.maketrans("“”‘’", "\"\"''")


def stripped(value: str) -> str:
    v = re.sub(r"\s*```\s*\Z", "", value.strip().strip("`")).strip()
    return v.strip(",").strip().strip('"').strip("'").strip()


def pieces(text: str) -> list[str]:
    """Parts of an answer that may be an object, in the order to try them: fenced blocks, all of it, from each brace to the next closing one."""
    s = text.strip()
    fenced = [m.group(1) for m in re.finditer(r"```(?:json)?\s*(.*?)(?:```|\Z)", s, re.I | re.S)]
    braced = [s[m.start() : end + 1 if (end := s.find("}", m.start())) >= 0 else None] for m in re.finditer(r"\{", s)]
    return list(dict.fromkeys(p.strip() for p in (*fenced, s, *braced) if p.strip()))


def with_text(obj: dict) -> dict:
    """An object that has detected_text if it has a text or any scalar."""
    if "detected_text" in obj:
        return obj
    value = obj["text"] if "text" in obj else first_value(obj)
    return obj | {"detected_text": value} if "text" in obj or value is not None else obj


def repaired(text: str) -> dict:
    """The member of the first part of an answer that is an object but for quotes and commas, or a broken object of one member, or a label and its value."""
    for part in pieces(text):
        s = re.sub(r",\s*}", "}", part.translate(QUOTES))
        if obj := parsed_object(s.replace("'", '"') if '"' not in s else s):
            return with_text(obj)
        for shape in (*BROKEN, LABELLED):
            if (m := re.fullmatch(shape, s, re.S)) and (value := stripped(m.group(1))):
                return {"detected_text": value}
    return {}


def answer_object(text: str | None) -> dict:
    """The object that an answer means: the first part that is one and isn't empty, else what can be repaired, else an empty one."""
    for part in pieces(text or ""):
        if obj := parsed_object(part):
            return with_text(obj)
    return repaired(text or "")


@F.pandas_udf(T.StringType())
def json_from_text(s: pd.Series) -> pd.Series:
    """JSON text of `answer_object`."""
    return s.map(lambda t: json.dumps(answer_object(t), ensure_ascii=False))


class StreamScanner:
    """Says when a growing text may stop, whatever pieces it comes in: as if each character came alone.

    A complete object with any text ends it; so does a broken one at the first closing brace, and a unit of LEAST_UNIT to MOST_UNIT
    characters that stands REPEATS times at the end. State: candidates for objects, how long each shift has matched, the last MOST_UNIT characters.
    """

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.n = s.get("n", 0)
        self.recent = np.frombuffer(s.get("tail", "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.live = [Candidate(*c) for c in s.get("live", [])]
        self.run = np.array(s.get("run", [0] * (MOST_UNIT + 1)), dtype=np.int32)
        self.first, self.closed = s.get("first", -1), s.get("closed", False)  # the first brace, whether one has closed since
        self.parts = [s.get("text", "")]

    @property
    def text(self) -> str:
        self.parts = ["".join(self.parts)]
        return self.parts[0]

    def dump(self) -> dict:
        tail = self.recent[-MOST_UNIT:].tobytes().decode("utf-32-le", "surrogatepass")
        return {"n": self.n, "tail": tail, "live": [c.dump() for c in self.live], "run": self.run.tolist(), "first": self.first, "closed": self.closed, "text": self.text}

    def objects(self, ch: str) -> list[int]:
        """Starts of objects that are complete with this character."""
        if ch == "{":
            self.live.append(Candidate(self.n))
        done, live = [], []
        for c in self.live:
            got = c.feed(ch)
            if got:
                done.append(c.start)
            elif got is None:
                live.append(c)
        self.live = live
        return done

    def feed(self, more: str) -> dict | None:
        """mode and end of the text, once it may stop."""
        kept = self.recent[-MOST_UNIT:]
        codes, before = np.concatenate([kept, np.frombuffer(more.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]), len(kept)
        for k, ch in enumerate(more):
            done = self.objects(ch)
            self.parts.append(ch)
            self.n += 1
            for start in done:
                if holds_text(self.text[start:]):
                    return {"mode": "json_object", "reason": "json_completion", "start": start, "end": self.n}
            if self.first < 0 and ch == "{":
                self.first = self.n - 1
            if self.first >= 0 and not self.closed and ch == "}":
                self.closed = True
                if self.first not in done and repaired(self.text[self.first :]):
                    return {"mode": "malformed_json_object", "reason": "json_completion", "start": self.first, "end": self.n}
            self.recent = codes[: before + k + 1]
            if unit := self._loop():
                return {"mode": "repeated_tail", "reason": "tail_repeat", "start": self.n - unit * REPEATS, "end": self.n - unit * (REPEATS - 1)}
        return None

    def _loop(self) -> int:
        """Length of the shortest unit that now stands REPEATS times at the end."""
        back = self.recent[-1 - MOST_UNIT : -1][::-1] == self.recent[-1]
        run = self.run[1 : len(back) + 1]
        run += 1
        run *= back
        if self.n < LEAST_TOTAL:
            return 0
        for unit in np.flatnonzero(self.run >= _ENOUGH).tolist():
            if self.recent[-unit:].tobytes().decode("utf-32-le", "surrogatepass").strip():
                return unit
        return 0


#: Matches in a row that make a loop, by the length of its unit.
_ENOUGH = np.array([(REPEATS - 1) * u if u >= LEAST_UNIT else 1 << 30 for u in range(MOST_UNIT + 1)])


def text_blocks(text: str) -> list[tuple[int, int, dict]]:
    """(start, end, object) of all objects with any text, wherever they begin, also within others, by their starts."""
    s, out = StreamScanner(), []
    for s.n, ch in enumerate(text):
        for start in s.objects(ch):
            obj = parsed_object(text[start : s.n + 1])
            if obj is not None and first_value(obj) is not None:
                out.append((start, s.n + 1, obj))
    return sorted(out, key=lambda b: b[0])


@F.pandas_udf(T.StructType([T.StructField("mode", T.StringType()), T.StructField("kept", T.StringType())]))
def stream_stop(s: pd.Series) -> pd.DataFrame:
    """mode and kept text of whole answers; those that never stop are kept whole."""
    got = [StreamScanner().feed(t) if t else None for t in s]
    return pd.DataFrame({"mode": [g and g["mode"] for g in got], "kept": [t[: g["end"]] if g else t for g, t in zip(got, s, strict=True)]})


@F.udtf(returnType="pos int, start int, end int, value string, canonical string")
class JsonBlocks:
    """Table function of a text: its objects with any text, with their spans, the text of their first scalar and one form for equal ones."""

    def eval(self, text: str):
        for k, (start, end, obj) in enumerate(text_blocks(text or "")):
            yield k, start, end, str(first_value(obj)), json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

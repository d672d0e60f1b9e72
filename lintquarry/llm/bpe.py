"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes exactly when each two neighbouring tokens are: merging their joined bytes
gives the two back. So the encoding of every prefix is that of a shorter prefix and one more token, and a
non-deterministic transducer reads bytes through the trie of all tokens, keeping one reading for each place where a token
may begin. Its determinised states are sets of such readings: (trie node, last token, tokens not yet emitted). What all
readings of a state agree on is emitted at once and leaves the state; a reading dies when no token continues it, so
lookahead is bounded by the longest token. States and steps are made when a text first needs them and kept in a table.

Decoding streams: a UTF-8 state machine carries unfinished characters from token to token; a token's effect on a state
is made once and kept.

Defined results: null and empty texts have no tokens; equal texts have equal ids; a pre-token of any length is read
byte by byte; malformed bytes decode as U+FFFD; an empty table gives no rows; other columns are ignored, and one that bears the name
asked for the result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Strangers, every_character, kept, ship

#: Determinised steps that a worker keeps at most; at the bound all states are dropped and made again as needed.
MAX_STEPS = 1 << 20
#: Pre-tokens whose output a worker remembers at most, and the longest remembered.
MAX_WORDS, WORD_CHARS = 1 << 19, 48


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: a base64 token and a number on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merged(ranks: dict[bytes, int], data: bytes, below: int = 1 << 60) -> list[bytes]:
    """The definition: join the neighbours of lowest rank, the leftmost first, until no join is a token (of a rank below)."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Reads the bytes of one pre-token and writes token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                after = self.children[node].get(b)
                if after is None:
                    after = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self._reset()

    def _reset(self) -> None:
        """Drop all states. A state is kept as packed integers, a step as one integer: millions of them must fit a worker."""
        start = _packed([(0, -1, ())])
        self.states: list[bytes] = [start]
        self.number = {start: 0}
        self.steps: dict[int, int] = {}
        self.outputs: list[tuple] = [()]
        self.output_number: dict[tuple, int] = {(): 0}
        self.ends: dict[int, tuple] = {0: ()}

    def _state(self, packed: bytes) -> int:
        n = self.number.get(packed)
        if n is None:
            n = self.number[packed] = len(self.states)
            self.states.append(packed)
        return n

    def _end(self, state: int) -> tuple:
        """What is still to emit if the text ends in a state."""
        if (got := self.ends.get(state)) is None:
            got = self.ends[state] = next(p for node, _, p in _readings(self.states[state]) if node == 0)
        return got

    def follows(self, last: int, token: int) -> bool:
        """Whether token may stand after last (-1: at the beginning)."""
        if last < 0:
            if token not in self.whole:
                self.whole[token] = merged(self.ranks, self.bytes_of[token]) == [self.bytes_of[token]]
            return self.whole[token]
        key = last << 32 | token
        if (got := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_STEPS:
                self.pairs.clear()
            got = self.pairs[key] = self._apart(last, token)
        return got

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the token's edge (side 1: its end, 0: its beginning) while it is merged together, each
        with the rank of the merge that absorbs it."""
        if (got := self.spines[side].get(token)) is None:
            part, until, got = self.bytes_of[token], 1 << 60, []
            while True:
                got.append((part, until))
                if len(part) == 1:
                    break
                rank = self.ranks[part]
                halves = merged(self.ranks, part, rank)
                if len(halves) != 2:
                    break
                part, until = halves[side], rank
            self.spines[side][token] = got
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b never joins over their border.

        Parts x, y at the border join if their rank is below that of the merge that absorbs x into a, and not above that of
        the merge that absorbs y into b (of equal ranks the left goes first).
        """
        rank = self.ranks.get
        for x, x_until in self._spine(a, 1):
            for y, y_until in self._spine(b, 0):
                m = rank(x + y)
                if m is not None and m < x_until and m <= y_until:
                    return False
        return True

    def _step(self, state: int, byte: int) -> int:
        """Determinise one step: move every reading, emit what all agree on. The step: next state and number of the output."""
        moved = []
        for node, last, pending in _readings(self.states[state]):
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and self.follows(last, token):
                moved.append((0, token, (*pending, token)))
            if self.children[child]:
                moved.append((child, last, pending))
        if not any(node == 0 for node, _, _ in moved):
            raise ValueError("a byte has no token")
        first = moved[0][2]
        agreed = min(len(p) for _, _, p in moved)
        for _, _, p in moved:
            k = 0
            while k < agreed and p[k] == first[k]:
                k += 1
            agreed = k
        after = self._state(_packed(sorted((node, last, p[agreed:]) for node, last, p in moved)))
        out = first[:agreed]
        n = self.output_number.get(out)
        if n is None:
            n = self.output_number[out] = len(self.outputs)
            self.outputs.append(out)
        got = self.steps[state << 8 | byte] = after << 32 | n
        return got

    def encode(self, data: bytes) -> list[int]:
        if len(self.steps) > MAX_STEPS:
            self._reset()
        out: list[int] = []
        state, get, outputs = 0, self.steps.get, self.outputs
        for byte in data:
            step = get(state << 8 | byte)
            if step is None:
                if len(self.steps) > 2 * MAX_STEPS:  # one pre-token has filled the table: keep only the state it is in
                    here = self.states[state]
                    self._reset()
                    state, get, outputs = self._state(here), self.steps.get, self.outputs
                step = self._step(state, byte)
            state = step >> 32
            emitted = step & 0xFFFFFFFF
            if emitted:
                out += outputs[emitted]
        out += self._end(state)
        return out


def _packed(readings: list[tuple]) -> bytes:
    flat = array("i")
    for node, last, pending in readings:
        flat.extend((node, last, len(pending), *pending))
    return flat.tobytes()


def _readings(packed: bytes) -> list[tuple]:
    flat, at, out = array("i", packed), 0, []
    while at < len(flat):
        n = flat[at + 2]
        out.append((flat[at], flat[at + 1], tuple(flat[at + 3 : at + 3 + n])))
        at += 3 + n
    return out


# ---------------------------------------------------------------- UTF-8


def _utf8_step(state: tuple[int, int, int, int], byte: int) -> tuple[tuple[int, int, int, int], str]:
    """state: (bytes still wanted, value so far, least and most value of the next byte); what a byte completes.

    A byte that can't continue a character ends it as U+FFFD and is read again from the start state.
    """
    wanted, value, low, high = state
    if wanted:
        if low <= byte <= high:
            value = value << 6 | byte & 63
            return ((0, 0, 0, 0), chr(value)) if wanted == 1 else ((wanted - 1, value, 0x80, 0xBF), "")
        after, text = _utf8_step((0, 0, 0, 0), byte)
        return after, "�" + text
    if byte < 0x80:
        return (0, 0, 0, 0), chr(byte)
    if 0xC2 <= byte <= 0xDF:
        return (1, byte & 31, 0x80, 0xBF), ""
    if 0xE0 <= byte <= 0xEF:
        return (2, byte & 15, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), ""
    if 0xF0 <= byte <= 0xF4:
        return (3, byte & 7, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), ""
    return (0, 0, 0, 0), "�"


class StreamingDecoder:
    """Token ids to text, piece by piece; characters may be split over tokens and calls."""

    START = (0, 0, 0, 0)

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.state = self.START
        self.known: dict[tuple, tuple] = {}
        self.complete: dict[int, str] = {}
        for i, t in bytes_of.items():
            after, text = self._run(self.START, t)
            if after == self.START:
                self.complete[i] = text

    @staticmethod
    def _run(state: tuple, data: bytes) -> tuple[tuple, str]:
        out = ""
        for b in data:
            state, text = _utf8_step(state, b)
            out += text
        return state, out

    def feed(self, ids: list[int]) -> str:
        """The text that ids complete."""
        if self.state == self.START:
            try:
                return "".join(map(self.complete.__getitem__, ids))
            except KeyError:
                pass
        out, state, known, start = [], self.state, self.known, self.START
        complete = self.complete.get
        for i in ids:
            if state is start and (text := complete(i)) is not None:
                out.append(text)
                continue
            got = known.get((state, i))
            if got is None:
                after, text = self._run(state, self.bytes_of[i])
                got = known[state, i] = (start if after == start else after, text)
                if len(known) > MAX_WORDS:
                    known.clear()
            state = got[0]
            out.append(got[1])
        self.state = state
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character leaves."""
        left, self.state = "�" * (self.state != self.START), self.START
        return left


# ---------------------------------------------------------------- whole texts


@cache
def strange_letters() -> str:
    """Characters that are letters or numbers by the regex module's tables and not by the encoding library's, or the other way."""
    import regex
    import tiktoken

    every, out = every_character(), set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes((i,)): i for i in range(256)}, special_tokens={})
        out |= set(library.decode(library.encode_ordinary(every))) ^ set(regex.findall(kind, every))
    return "".join(sorted(out))


class Codec:
    """Encodes texts, each match of the pattern separately, and decodes ids."""

    def __init__(self, data: bytes, pattern: str, strange: str | None = None):
        import regex

        self.transducer = Transducer(ranks_of(data))
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.strangers = Strangers(strange_letters() if strange is None else strange)
        # two generations: when the younger is full the elder goes, but words still in use have moved to the younger
        self.words: dict[str, tuple[int, ...]] = {}
        self.elder: dict[str, tuple[int, ...]] = {}
        self.decoder = StreamingDecoder(self.transducer.bytes_of)
        self.decimal = {i: str(i) for i in self.transducer.bytes_of}

    def matches(self, text: str) -> list[str]:
        if self.strangers.within(text):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.strangers.table))]
        return self.split(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        get, extend = self.words.get, out.extend
        for word in self.matches(text or ""):
            ids = get(word)
            if ids is None:
                ids = self.elder.get(word)
                if ids is None:
                    ids = tuple(self.transducer.encode(word.encode("utf-8", "replace")))
                if len(word) <= WORD_CHARS:
                    if len(self.words) >= MAX_WORDS // 2:
                        self.elder, self.words = self.words, {}
                        get = self.words.get
                    self.words[word] = ids
            extend(ids)
        return out

    def decode(self, ids: list[int], piece: int = 1 << 16) -> str:
        return "".join([self.decoder.feed(ids[k : k + piece]) for k in range(0, len(ids), piece)]) + self.decoder.end()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        ids = self.encode(text)
        said = " ".join(map(self.decimal.__getitem__, ids))
        back = self.decode(ids).encode("utf-8")
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def _sent(spark, ranks_path: str, pattern: str):
    with open(ranks_path, "rb") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast((data, pattern, strange_letters()))
    ship(spark)
    key = hashlib.md5(data + pattern.encode()).hexdigest()
    return lambda: kept("bpe", key, lambda: Codec(*sent.value))


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with the token ids of a text column."""
    codec = _sent(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([c.encode(t.as_py()) for t in texts], pa.list_(pa.int32()))

    return docs.withColumn(name, encode(text))


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the text of a column of token ids; null for null."""
    codec = _sent(df.sparkSession, ranks_path, pattern)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        c = codec()
        return pa.array([None if (r := x.as_py()) is None else c.decode(r) for x in rows], pa.string())

    return df.withColumn(name, decode(ids))


def digest_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes: encode and decode in one pass."""
    codec = _sent(docs.sparkSession, ranks_path, pattern)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(texts: pa.Array) -> pa.Array:
        c = codec()
        rows = [c.digest(t.as_py()) for t in texts]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.StructArray.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")

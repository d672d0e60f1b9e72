"""Token counts by a two-tier lookup, without shuffling a pre-token.

Tier one is a compact table from frequent pre-token to its number of tokens, broadcast to every worker. Pre-tokens are counted in a
sample of ``sample_docs`` documents dealt over the whole table: each task counts its own, keeps the most frequent and gives them on
as one row; the rows are merged in the same way, and the ``frequent`` most frequent are encoded once. The table's size is that
parameter's, whatever the corpus. Tier two is a cache in each worker: pre-tokens that miss both are encoded once by the
tokenizer, a batch at a time, and remembered up to a bound. What the table holds changes the time taken, never a count.

Defined results: null and empty texts have 0 tokens; equal texts have equal counts; very long texts are counted whole; rows of a null or
repeated doc_id are rows of their own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Strangers, every_character, kept, ship

#: Pre-tokens that a worker remembers at most; the cache is emptied when it is full.
CACHE_WORDS = 1 << 19
#: Longer pre-tokens are counted without being remembered.
CACHED_CHARS = 64


@dataclass(frozen=True)
class Params:
    #: Pre-tokens in the broadcast table at most.
    frequent: int = 1 << 15
    #: Documents, about, that they are counted in.
    sample_docs: int = 2_000
    #: Tasks that merge the counts; so many rows come to the driver.
    merges: int = 8
    seed: int = 3


#: White space as the library's expressions have it.
SPACE = r"\t-\r\x85\p{Z}"


def normalised(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # the library lowers each character for itself
        text = text.replace("Σ", "σ")
    return text.lower()


@cache
def strange_characters() -> str:
    """Characters that the library's Unicode tables know otherwise than the regex module's and Python's."""
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    every, out = every_character(), set()
    for kind, own in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", f"[{SPACE}]")):
        out |= {x for x, _ in pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(every)} ^ set(regex.findall(own, every))
    apart = "\x01".join(every.replace("\x01", ""))
    library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(apart)
    out |= {x for x, a, b in zip(apart.split("\x01"), library.split("\x01"), normalised(apart).split("\x01"), strict=True) if a != b}
    return "".join(sorted(out))


class WordCounter:
    """Counts tokens as the tokenizers library does for a model with word ends, lower case and dropped white space."""

    def __init__(self, model: str, tier_one: dict[str, int] | None = None, strange: str | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(model)
        conf = json.loads(model)
        splits = [x["pattern"]["Regex"] for x in conf["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        kinds = [x["type"] for x in conf["normalizer"]["normalizers"]]
        if len(splits) != 1 or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word-end model with one splitting pattern")
        self.words = regex.compile(splits[0].replace(r"[^\s", f"[^{SPACE}")).findall
        self.strangers = Strangers(strange_characters() if strange is None else strange)
        special = [x["content"] for x in conf["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tier_one = tier_one or {}
        self.cache: dict[str, int] = {}

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def pretokens(self, text: str) -> list[str]:
        return self.words(normalised(text))

    def parts(self, text: str | None) -> list[str]:
        """What stands before, between and after special strings, each of which is one token."""
        if self.special and text and self.special.search(text):
            return self.special.split(text)
        return [text or ""]

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        first, cache = self.tier_one.get, self.cache
        for text in texts:
            if text and self.strangers.within(text):
                out += self.lengths([text])
                continue
            parts = self.parts(text)
            n = len(parts) - 1
            for part in parts:
                words = self.pretokens(part)
                lengths = [first(w) or cache.get(w) for w in words]
                if None in lengths:
                    missed = list({w for w, k in zip(words, lengths, strict=True) if k is None})
                    known = dict(zip(missed, self.lengths(missed), strict=True))
                    lengths = [known[w] if k is None else k for w, k in zip(words, lengths, strict=True)]
                    if len(cache) + len(known) > CACHE_WORDS:
                        cache.clear()
                    cache.update((w, k) for w, k in list(known.items())[:CACHE_WORDS] if len(w) <= CACHED_CHARS)
                n += sum(lengths)
            out.append(n)
        return out


def _packed(total: Counter, most: int) -> pa.RecordBatch:
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]
    return pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "counts"])


def frequent_words(docs: DataFrame, model: str, p: Params = Params()) -> list[str]:
    """The most frequent pre-tokens of a sample of the documents, most frequent first."""
    spark = docs.sparkSession
    ship(spark)
    sent, key, schema = spark.sparkContext.broadcast((model, None, strange_characters())), hashlib.md5(model.encode()).hexdigest(), "words array<string>, counts array<bigint>"

    def counted(batches):
        counter, total = kept("pretokens", key, lambda: WordCounter(*sent.value)), Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in counter.parts(text.as_py()):
                    total.update(counter.pretokens(part))
                if len(total) > 16 * p.frequent:
                    total = Counter(dict(total.most_common(8 * p.frequent)))
        if total:
            yield _packed(Counter({w: n for w, n in total.items() if len(w) <= CACHED_CHARS}), 4 * p.frequent)

    def merged(batches):
        total = Counter()
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                total.update(dict(zip(words.as_py(), counts.as_py(), strict=True)))
                if len(total) > 16 * p.frequent:
                    total = Counter(dict(total.most_common(8 * p.frequent)))
        if total:
            yield _packed(total, 4 * p.frequent)

    n = docs.count()
    sample = docs.select("text").sample(min(1.0, p.sample_docs / n), p.seed) if n > p.sample_docs else docs.select("text")
    total: Counter = Counter()
    for words, counts in sample.mapInArrow(counted, schema).repartition(p.merges).mapInArrow(merged, schema).toLocalIterator():
        total.update(dict(zip(words, counts, strict=True)))
    return [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: p.frequent]]


def token_counter(docs: DataFrame, model_path: str, p: Params = Params()):
    """A column function text -> number of tokens, with the frequent pre-tokens of docs; the model file is read on the driver and sent to
    the workers."""
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    words = frequent_words(docs, model, p)
    lengths = WordCounter(model).lengths(words) if words else []
    sent = docs.sparkSession.sparkContext.broadcast((model, dict(zip(words, lengths, strict=True)), strange_characters()))
    key = hashlib.md5((model + repr(words)).encode()).hexdigest()

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        counter, out = kept("words", key, lambda: WordCounter(*sent.value)), []
        for k in range(0, len(texts), 256):
            out += counter.count(texts[k : k + 256].to_pylist())
        return pa.array(out, pa.int64())

    return n_tokens


def count_tokens(docs: DataFrame, model_path: str, limit: int = 2048, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the document is over the limit."""
    n = token_counter(docs, model_path, p)
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), n("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

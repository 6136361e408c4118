"""Token counts of whole texts, exact for documents of any length.

Texts up to ``chunk_chars`` are encoded at once. A longer text is cut into chunks that overlap; each chunk is encoded with
offsets and spliced to the one before it at a *stable common boundary*: a place where a pre-token starts in both. The
earlier chunk's pre-tokens are the whole text's up to ``margin`` before its end (they are cut greedily from the left and
look one character ahead), and from such a place on the later chunk's are, too, as no pre-token looks back. A boundary also
has to lie clear of the strings of special tokens, which are split off first. Where no common boundary is found the overlap
is doubled, up to encoding the rest of the text at once.

Edge cases: null and empty texts count 0; repeated rows are counted one by one; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def boundaries(encoding, shift: int = 0) -> dict[int, int]:
    """Place in the text -> index of the first token of the pre-token that starts there."""
    found: dict[int, int] = {}
    last = None
    for i, (word, (start, end)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last and word is not None:
            found[shift + start] = i
        last = word
    return found


def spliced_count(text: str, encode, chunk_chars: int = 50_000, overlap: int = 1_000, margin: int = 64, specials: tuple[str, ...] = ("<|endoftext|>",)) -> int:
    """Tokens of ``text`` from overlapping chunks; ``encode`` gives an encoding with offsets and word ids.

    ``margin`` is longer than any special token's string and than the look-ahead of the pre-tokens.
    """
    if len(text) <= chunk_chars:
        return len(encode(text).ids)
    total, start, skip = 0, 0, 0  # skip: tokens at this chunk's start that belong to the one before
    current = encode(text[:chunk_chars])
    end = chunk_chars
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            if begin == start:  # no stable boundary in the whole chunk: make the chunk itself longer
                end = min(len(text), end + max(chunk_chars, end - start))
                current = encode(text[start:end])
                if end == len(text):
                    return total + len(current.ids) - skip
                width = overlap
                continue
            upto = min(len(text), begin + chunk_chars + width)
            following = encode(text[begin:upto])
            earlier, later = boundaries(current, start), boundaries(following, begin)
            common = [p for p in earlier.keys() & later.keys() if begin + margin <= p <= end - margin and earlier[p] >= skip and _clear(text, p, specials)]
            if common:
                break
            width *= 2
        at = max(common)
        total += earlier[at] - skip
        start, end, current, skip = begin, upto, following, later[at]
    return total + len(current.ids) - skip


def _clear(text: str, p: int, specials: tuple[str, ...]) -> bool:
    """No string of a special token lies at p or across it."""
    near = max(map(len, specials), default=0)
    around = text[max(0, p - near) : p + near]
    return not any(s in around for s in specials)


class UnitCounts:
    """Counts of short texts from their units: a single space between two visible characters always starts a pre-token, so
    the parts between such spaces are encoded apart, each distinct one once. Bounded: emptied beyond ``most`` units."""

    def __init__(self, tokenizer, most: int = 600_000) -> None:
        self.tokenizer, self.most = tokenizer, most
        self.first: dict[str, int | None] = {}
        self.inner: dict[str, int | None] = {}

    def _learn(self, memo: dict, parts: list[str], lead: str) -> None:
        good = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        memo.update(dict.fromkeys(parts))  # None: not a unit of its own, its text is encoded whole
        for a in range(0, len(good), 4096):
            part = good[a : a + 4096]
            memo.update(zip(part, map(len, self.tokenizer.encode_batch_fast([lead + p for p in part], add_special_tokens=False))))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.inner) + len(self.first) > self.most:
            self.first.clear()
            self.inner.clear()
        split = [t.split(" ") for t in texts]
        self._learn(self.first, [p for p in {s[0] for s in split} if p not in self.first], "")
        self._learn(self.inner, list(set().union(*(s[1:] for s in split)).difference(self.inner)), " ")
        out: list[int | None] = []
        for s in split:
            try:
                out.append(self.first[s[0]] + sum(map(self.inner.__getitem__, s[1:])))
            except TypeError:
                out.append(None)
        whole = [i for i, n in enumerate(out) if n is None]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = len(e)
        return out


def token_counts(docs: DataFrame, path: str, chunk_chars: int = 32_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row. ``path`` is the tokenizer's file, present on each executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        units = _loaded.setdefault(f"units of {path}", UnitCounts(t))
        encode = lambda x: t.encode(x, add_special_tokens=False)
        for texts in batches:
            counts = pd.Series(0, index=range(len(texts)), dtype="int64")
            short = [i for i, x in enumerate(texts) if x and len(x) <= chunk_chars]
            for a in range(0, len(short), 500):
                counts.iloc[short[a : a + 500]] = units.counts([texts.iloc[i] for i in short[a : a + 500]])
            for i, x in enumerate(texts):
                if x and len(x) > chunk_chars:
                    counts.iloc[i] = spliced_count(x, encode, chunk_chars)
            yield counts

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}

"""Token counts of a byte-level BPE tokenizer without materialising ids.

Each text becomes its pre-token frequencies. The distinct pre-tokens of all texts form one table, with the tokens of
each counted once; it is joined to the documents' frequencies on the pre-token, and frequency times tokens is summed by
document. Pre-tokens follow a power law, so the join has two exact parts: the most frequent pre-tokens (COMMON at most,
none longer than SHORT) are a broadcast table, and all others are (row, pre-token, frequency) rows joined by shuffle,
in which a pre-token that holds much of the rows is broadcast too.

Special strings inside a text count as the library does by default: one token each, matched before pre-tokenising.
Very long texts are cut between a letter and a space with a letter after it, where pre-tokens always part.

Defined cases: null counts as empty, 0 bytes and 0 tokens; ids may repeat or be null, each row is answered by itself;
only id and text are read; with no rows the result is empty.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, slices, staged

#: Pre-tokens that are broadcast, and their UTF-8 bytes, at most; distinct pre-tokens that a task tallies before it emits them.
COMMON, SHORT, HELD = 200_000, 64, 400_000
#: Bytes of text after which a task emits its tally in any case, as pre-tokens may be very long.
READ = 256 << 20
LONG = 1 << 20
#: The pre-token pattern of byte-level BPE, and the characters for which the two regular expression
#: libraries are known to agree on letters, numbers and spaces; other texts are split by the tokenizer itself.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\x00-\x1b\x20-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u2030-\u203a\u20ac]")
_SAFE = re.compile(r"(?<=[a-z])(?= [a-z])")


class Splitter:
    """Pre-tokens of texts, and tokens of pre-tokens, of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        added = spec.get("added_tokens") or []
        first = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and first.get("type") == "ByteLevel" and spec["model"]["type"] == "BPE"
        plain = plain and not first.get("add_prefix_space") and first.get("use_regex", True)  # else pre-tokens are others than PATTERN's
        if not plain or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path}: only byte-level BPE without a normaliser, and added tokens that match as they are")
        self.tokenizer = tok
        self.findall = regex.compile(PATTERN).findall
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def split(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return self.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def tally(self, text: str, into: Counter) -> int:
        """Adds the text's pre-token frequencies; returns the number of special tokens met."""
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            at = 0
            while len(part) - at > LONG and (m := _SAFE.search(part, at + LONG)):
                into.update(self.split(part[at : m.start()]))
                at = m.start()
            into.update(self.split(part[at:]))
        return len(parts) - 1

    def tokens(self, pretokens: list[str]) -> list[int]:
        return [*map(len, self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False))]


_OPEN: dict[str, Splitter] = {}


def _open(path: str) -> Splitter:
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        _OPEN[path] = Splitter(path)
    return _OPEN[path]


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """Rows (piece, n, tokens): each distinct pre-token of column text, its frequency in all texts, its tokens."""

    def emit(tally):
        return pa.record_batch([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["piece", "n"])

    def seen(batches):
        tally: Counter = Counter()
        read = 0
        for batch in slices(batches):
            read += batch.nbytes
            for text in batch.column("text").to_pylist():
                _open(path).tally(text or "", tally)
                if len(tally) > HELD or read > READ:
                    yield emit(tally)
                    tally, read = Counter(), 0
        yield emit(tally)

    def counted(batches):
        for batch in slices(batches):
            tokens = _open(path).tokens(batch.column("piece").to_pylist())
            yield pa.record_batch([batch.column("piece"), batch.column("n"), pa.array(tokens, pa.int64())], ["piece", "n", "tokens"])

    distinct = texts.select("text").mapInArrow(seen, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(counted, "piece string, n long, tokens long")


def least_common(vocab: DataFrame, common: int) -> tuple[int, int]:
    """The least frequency at which pre-tokens are common, so that those are `common` at most, and the number of other pre-tokens.

    The driver gets a histogram of frequencies, sixteen bins a doubling.
    """
    bins = vocab.groupBy(F.floor(16 * F.log2("n")).alias("bin")).agg(F.count("*").alias("pieces"), F.min("n").alias("least"), F.sum((F.octet_length("piece") > SHORT).cast("long")).alias("long"))
    held, least, rest = 0, 1 << 62, 0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        held += row["pieces"]
        if held <= common:
            least, rest = row["least"], rest + row["long"]
        else:
            rest += row["pieces"]
    return least, rest


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """Rows (id, n_bytes, n_tokens) for each row of docs. path: a tokenizer file that every executor has."""
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    vocab = staged(vocabulary(given, path), "pretokens")
    least, rest = least_common(vocab, common)
    is_common = (F.col("n") >= least) & (F.octet_length("piece") <= SHORT)
    table = vocab.filter(is_common).select("piece", "tokens").toPandas()
    held = docs.sparkSession.sparkContext.broadcast(dict(zip(table["piece"], table["tokens"].tolist(), strict=True)))
    pair = pa.list_(pa.struct([("piece", pa.string()), ("freq", pa.int64())]))

    def run(batches):
        known = held.value
        for batch in slices(batches):
            sums, others = [], []
            for text in batch.column("text").to_pylist():
                own: Counter = Counter()
                n, other = _open(path).tally(text or "", own), []
                for piece, freq in own.items():
                    tokens = known.get(piece)
                    if tokens is None:
                        other.append({"piece": piece, "freq": freq})
                    else:
                        n += freq * tokens
                sums.append(n)
                others.append(other)
            yield pa.record_batch([batch.column("id"), batch.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(others, pair)], ["id", "n_bytes", "n", "others"])

    part = given.mapInArrow(run, f"id {kind}, n_bytes long, n long, others array<struct<piece:string,freq:long>>")
    if not rest:
        return part.select(F.col("id").alias(id_col), "n_bytes", F.col("n").alias("n_tokens"))
    part = staged(part.withColumn("row", F.monotonically_increasing_id()), "frequencies")  # row numbers hold once written
    others = part.select("row", F.inline("others"))
    more = join_skewed(others, vocab.filter(~is_common).select("piece", "n", "tokens"), "piece", "n").groupBy("row").agg(F.sum(F.col("freq") * F.col("tokens")).alias("more"))
    return part.join(more, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op6(docs: DataFrame, path: str) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > 512)

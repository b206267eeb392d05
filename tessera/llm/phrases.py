"""Phrase collocation mining by suffix sorting.

Each piece of text gives, for every word, the suffix that begins there, cut to max_n words. A task counts equal suffixes
before it sends them. Suffixes are dealt by ranges of (language, first word, following words) and sorted in descending
order, so all suffixes of a first word lie together, in one task or, where there are very many, in neighbouring ones. One
pass with one stack of open prefixes, a language, a word, two words and so on, then counts every phrase: a prefix whose
suffixes end is closed, and is sent on if it is frequent. The prefixes at a range's two ends may go on next door, so they
are sent on whatever their count, and the parts are summed. A word, a pair or a language of any share of the rows is
thus split, and no vocabulary is held by the driver or broadcast.

A phrase's parts are frequent if it is, so their counts are joined from the same table. Arithmetic is in whole decimals.

Within a suffix the words are joined by SEP; a word's control characters up to it are written as ESC and a character, so
that no word sorts below the separator.

Defined cases: a null or empty text has no words; a null language is `und`, an empty one is itself; repeated rows all
count; an empty table gives no rows; texts of any length are read whole, block by block; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_small, slices, staged, tasks_for

SEP, ESC = "\t", "\n"
#: Words that a task holds before it counts suffixes; bytes of text that it splits at once; rows that it sends at once.
HELD, BLOCK, SENT = 2_000_000, 4 << 20, 100_000
#: Bytes of text for each task that sorts suffixes.
SORTED_BYTES = 64 << 20
_ENDS = b".,;:!?\n\v\f\r"
#: A-Z to a-z, the ends of pieces to a line feed, tabs to spaces.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(_ENDS) + b" ")
_LOW = re.compile(rb"[\x00-\x0a]")
#: Numbers of the empty string, which is no word, and of a piece's end.
_NONE, _END = 0, 1


def _escaped(word: bytes) -> bytes:
    return _LOW.sub(lambda m: ESC.encode() + bytes([48 + m[0][0]]), word)


def unescaped(text: Column) -> Column:
    """A word, language or phrase as it was in the text."""
    plain = text
    for k in range(11):  # ESC itself is the last, so none that is written is read again
        plain = F.replace(plain, F.lit(ESC + chr(48 + k)), F.lit(chr(k)))
    return F.when(text.contains(ESC), plain).otherwise(text)


def _numbers(text: bytes, vocab: dict) -> np.ndarray:
    """The numbers of a text's words, with _END between pieces and at its end."""
    text, out, at = text.translate(_PLAIN).replace(b"\n", b" \n "), [], 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        ids = np.fromiter(map(vocab.__getitem__, text[at:end].split(b" ")), np.int64)
        out.append(ids[ids != _NONE])
        at = end + 1
    return np.concatenate([*out, [_END]])


def _distinct(ids: np.ndarray, n: int, rank: np.ndarray, max_n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct suffixes of max_n words that begin at the first n of ids, as ranks of words (0: none), in descending order, and their counts."""
    ids = np.concatenate([ids, np.full(max_n - 1, _END)])
    ended, base = np.zeros(n, bool), len(rank) + 1
    code, words = np.zeros(n, np.int64), []
    for k in range(max_n):
        own = ids[k : k + n]
        ended |= own == _END
        words.append(np.where(ended, 0, rank[own]))
        if k and base ** (k + 1) >= 1 << 62:  # codes become dense numbers of the same order
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + words[-1]
    began = np.flatnonzero(words[0])
    _, first, count = np.unique(code[began], return_index=True, return_counts=True)
    first = began[first[::-1]]
    return [w[first] for w in words], count[::-1]


def _suffixes(max_n: int):
    def emit(vocab, held):
        names = sorted(vocab)
        rank = np.empty(len(vocab), np.int64)
        rank[[vocab[w] for w in names]] = np.arange(1, len(vocab) + 1)
        spelt = pa.array([None, *map(_escaped, names)], pa.binary())
        for lang, parts in held.items():
            ids, first = np.concatenate(parts), pa.scalar(_escaped(lang), pa.binary())
            for at in range(0, len(ids), HELD):
                words, count = _distinct(ids[at : at + HELD + max_n - 1], min(HELD, len(ids) - at), rank, max_n)
                for k in range(0, len(count), SENT):
                    taken = [spelt.take(pa.array(w[k : k + SENT])) for w in words]
                    suffix = pc.binary_join_element_wise(first, *taken, SEP.encode(), null_handling="skip")
                    yield pa.record_batch([suffix.cast(pa.string()), pa.array(count[k : k + SENT])], ["suffix", "n"])

    def run(batches):
        vocab, held, n = None, {}, 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if vocab is None:
                    vocab = defaultdict()
                    vocab.default_factory = vocab.__len__
                    vocab[b""], vocab[b"\n"]  # _NONE and _END
                held.setdefault(lang, []).append(_numbers(text, vocab))
                n += len(held[lang][-1])
                if n >= HELD:
                    yield from emit(vocab, held)
                    vocab, held, n = None, {}, 0
        if held:
            yield from emit(vocab, held)

    return run


def _prefixes(max_n: int, least: int):
    """Counts of prefixes from rows (suffix, n) in descending order: (lang, phrase, words, f), phrase null for a language's words."""

    def run(batches):
        # what is open at each level: [words joined by SEP or None, count, whether its suffixes may have begun before this task's]
        stack: list[list] = []
        last: list[str] | None = None

        def rows(found):
            lang = [x[0].partition(SEP)[0] for x in found]
            phrase = [x[0].partition(SEP)[2] if SEP in x[0] else None for x in found]
            return pa.record_batch([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array([x[0].count(SEP) for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())], ["lang", "phrase", "words", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = pc.split_pattern(batch.column("suffix"), SEP)
            start, flat, n = parts.offsets.to_numpy(), parts.values, batch.column("n").to_numpy()
            size = np.diff(start)
            cols, found = [], []
            changed = np.zeros(len(n), bool)
            for level in range(max_n + 1):
                there = size > level
                col = pc.fill_null(flat.take(pa.array(start[:-1] + level, mask=~there)), "")
                cols.append(col)
                changed = changed | np.concatenate([[last is None or col[0].as_py() != last[level]], pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)])
                at = np.flatnonzero(changed)
                before = int(n[: at[0]].sum()) if len(at) else int(n.sum())
                if last is not None:
                    stack[level][1] += before
                if not len(at):
                    continue
                sums = np.add.reduceat(n, at)
                if last is not None:
                    name, count, edge = stack[level]
                    if name is not None and (edge or count >= least or level == 0):
                        found.append((name, count))
                whole = np.arange(len(at)) < len(at) - 1
                keep = np.flatnonzero(whole & there[at] & ((sums >= least) | (level == 0)))
                if last is None and len(at) > 1 and there[at[0]] and 0 not in keep:
                    keep = np.concatenate([[0], keep])
                if len(keep):
                    rows_at = pa.array(at[keep])
                    name = cols[0].take(rows_at) if not level else pc.binary_join_element_wise(*[c.take(rows_at) for c in cols[: level + 1]], SEP)
                    found += zip(name.to_pylist(), sums[keep].tolist(), strict=True)
                row = int(at[-1])
                name = SEP.join(c[row].as_py() for c in cols[: level + 1]) if there[row] else None
                entry = [name, int(sums[-1]), last is None and len(at) == 1]
                if level < len(stack):
                    stack[level] = entry
                else:
                    stack.append(entry)
            last = [c[len(n) - 1].as_py() for c in cols]
            if found:
                yield rows(found)
        if stack and (found := [(name, count) for name, count, _ in stack if name is not None]):
            yield rows(found)

    return run


def counts(docs: DataFrame, max_n: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): the phrases of up to max_n words that a language holds at least `least` times, words joined by SEP.

    A null phrase of 0 words has the language's words.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang")
    given = docs.select(lang, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    tasks = tasks_for(spark, given.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SORTED_BYTES)
    suffixes = given.mapInArrow(_suffixes(max_n), "suffix string, n long")
    dealt = suffixes.repartitionByRange(tasks, F.desc("suffix")).sortWithinPartitions(F.desc("suffix"))
    part = dealt.mapInArrow(_prefixes(max_n, least), "lang string, phrase string, words int, f long")
    return part.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("words").eqNullSafe(0) | (F.col("f") >= least))


def _joined(words: str, start: str, length: str) -> Column:
    return F.expr(f"array_join(slice({words}, {start}, {length}), '{SEP}')")


def scored(counted: DataFrame, share: int) -> DataFrame:
    """(phrase, lang, a, l, r, score): phrases of two words and more by their weakest cut, without those of which a longer
    phrase that holds them has `share` percent of the occurrences or more."""
    phrases = counted.filter("words > 0").select("phrase", "lang", "words", "f")
    part = phrases.select("lang", F.col("phrase").alias("part"), "f")
    cand = phrases.filter("words > 1").select("phrase", "lang", F.col("f").alias("a"), F.split("phrase", SEP).alias("w"))
    cuts = cand.select("phrase", "lang", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("phrase", "lang", "a", "k", _joined("w", "1", "k").alias("first"), _joined("w", "k + 1", "size(w) - k").alias("rest"))
    # one row a phrase on the right, so Spark may split a frequent part's rows on the left among tasks
    cuts = cuts.join(part.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).drop("first")
    cuts = cuts.join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(14,0)") for c in "alr"}
    score = F.call_function("div", 1_000_000 * exact["a"] * exact["a"], exact["l"] * exact["r"])
    scores = cuts.select("phrase", "lang", F.struct(score.alias("score"), "k", "a", "l", "r").alias("cut"))
    lowest = scores.groupBy("phrase", "lang").agg(F.min("cut").alias("cut")).select("phrase", "lang", "cut.*")
    spans = F.expr(f"flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), '{SEP}'))))")
    held = cand.filter("size(w) > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("phrase", "lang").agg(F.max("a").alias("longer"))
    return lowest.join(held, ["phrase", "lang"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("phrase", "lang", "a", "l", "r", "score")


def first_by_score(phrases: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language with their rank. Each task ranks what it has of a language, then the winners meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("_salt")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score."""
    counted = staged(counts(docs, max_n, least, text_col, lang_col), "phrases")
    found = scored(counted, share).select("lang", unescaped(F.col("phrase")).alias("phrase"), "a", "l", "r", "score")
    found = first_by_score(found.withColumn("phrase", F.translate("phrase", SEP, " ")), top)
    found = join_small(found.select("phrase", "lang", "rank", "a", "l", "r", "score"), counted.filter("words = 0").select("lang", F.col("f").alias("n")), ["lang"])
    return found.select(unescaped(F.col("lang")).alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
totals as (select lang, sum(len(w))::bigint as n from pieces group by 1),
grams as (
  select lang, w[i:i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3]) as k))),
f as (select lang, g, count(*) as f from grams group by all having count(*) >= 10),
cuts as (
  select c.lang, c.g, c.f as a, k, l.f as l, r.f as r, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, len(g))) as k from f where len(g) > 1) c
  join f l on l.lang = c.lang and l.g = c.g[1:k] join f r on r.lang = c.lang and r.g = c.g[k + 1:]),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
held as (select lang, p, max(f) as longer from (select lang, f, unnest([g[1:2], g[2:3]]) as p from f where len(g) = 3) group by all),
phrases as (
  select lowest.lang, array_to_string(g, ' ') as phrase, a, l, r, score
  from lowest left join held on held.lang = lowest.lang and held.p = lowest.g where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from phrases)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""

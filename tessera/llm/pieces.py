"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three parts. The normaliser rewrites characters (the model's map, longest match first),
white space (runs, ends, dummy prefix) and writes a space as U+2581. The piece arcs read a piece's characters and write
its id; a character that no piece has gets an arc of its own, which writes the ids of its bytes, or the unknown id. A
text is composed with them into a lattice over its positions, and the encoding is the path of least weight in the
tropical semiring (min, +): the relaxation takes the least of distance plus weight over the arcs into each position.

In a unigram model an arc weighs the negative score of its piece. In a BPE model the result is no sum of piece scores:
the order of merges decides. There every arc weighs one, and the states carry the last piece: an arc may follow it only
(weigh less than infinity) if the model's merges, run on the two pieces' characters, leave the border between them. One
path only obeys all borders, so of the arcs into a position one is finite, and the relaxation stops at it.

Decoding runs the arcs backwards. Where no piece crosses from a character to a following U+2581 the lattice of a BPE
model falls into words; a worker keeps the paths of the words it has met (CACHE at most, then it starts anew). Weights of
a unigram model are summed in 32-bit floats from the start of the text, as the library does: equal paths differ by the
rounding only, so a text is one lattice.

Models with user-defined or unused pieces are read if they are unigram models; word and character models are refused.

Defined cases: null gives null ids, pieces 0 and null text; an empty text gives no ids and an empty text; an empty table
gives no rows; a text of any length is encoded whole; U+2581 in a text comes back as a space, as the library does; equal
texts get equal ids; ids may repeat or be null; only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

CACHE, BORDERS = 1_200_000, 1_000_000
BAR = "▁"
LONG = 1 << 20


class _Paths(dict):
    """The paths of words, found when first asked for; very long words are not kept."""

    def __init__(self, find) -> None:
        self.find = find

    def __missing__(self, word: str) -> bytes:
        got = self.find(word)
        if len(word) < 64:
            self[word] = got
        return got


class Normaliser:
    """The model's rewriting of a text before pieces are found."""

    def __init__(self, spec, user: set[str], suffix: bool) -> None:
        self.squeeze, self.escape, self.suffix = spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.space = BAR if self.escape else " "
        self.dummy = self.space if spec.add_dummy_prefix else ""
        self.user = sorted((u.encode() for u in user), key=len, reverse=True)
        self.units, self.blob = None, b""
        if spec.precompiled_charsmap:
            held = spec.precompiled_charsmap
            size = int.from_bytes(held[:4], "little")
            self.units, self.blob = np.frombuffer(held[4 : 4 + size], "<u4").tolist(), held[4 + size :]
        self.known: dict[bytes, bytes] = {}
        self.plain = self.units is None and not self.squeeze and not self.user and not suffix and self.escape

    def _mapped(self, at: bytes) -> tuple[int, bytes] | None:
        """The longest key of the map that `at` starts with: (its length, what replaces it). The map is a double array."""
        units, found, offset = self.units, None, lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for n, c in enumerate(at):
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = n + 1, self.blob[start : self.blob.index(b"\0", start)]
        return found

    def _next(self, text: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, bytes written) at a position."""
        for u in self.user:
            if text.startswith(u, at):
                return len(u), u
        if self.units is not None and (got := self._mapped(text[at : at + 64])):
            return got
        c = text[at]
        n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        return n, text[at : at + n]

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return self.dummy + text.replace(" ", BAR)
        raw, at, out = text.encode("utf-8", "replace"), 0, []
        while self.squeeze and at < len(raw):
            n, got = self._next(raw, at)
            if got != b" ":
                break
            at += n
        if at == len(raw):
            return ""
        after = self.squeeze
        while at < len(raw):
            n, got = self._next(raw, at)
            at += n
            if after:
                got = got.lstrip(b" ")
            if got:
                out.append(got)
                after = got.endswith(b" ")
            if not self.squeeze:
                after = False
        done = b"".join(out).decode("utf-8", "replace").replace(" ", self.space)
        if self.squeeze:
            done = done.rstrip(self.space)
        return done + self.dummy if self.suffix else self.dummy + done


class Transducer:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.trainer_spec
        self.merges = spec.model_type == 2
        kinds = {p.type for p in model.pieces}
        if spec.model_type not in (1, 2) or self.merges and kinds & {4, 5}:
            raise ValueError(f"{path}: only unigram models, and BPE models without user-defined or unused pieces")
        user = {p.piece for p in model.pieces if p.type == 4}
        self.normal = Normaliser(model.normalizer_spec, user, spec.treat_whitespace_as_suffix)
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        scores = [p.score for p in model.pieces if p.type == 1]
        self.score = {p.piece: 0.1 * (len(p.piece.encode()) - 1) if p.type == 4 else p.score for p in model.pieces if p.type in (1, 4)}
        self.missing = min(scores, default=0.0) - 10
        self.byte = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6} if spec.byte_fallback else {}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        self.endings = {p[k:] for p in self.id for k in range(len(p))}
        self.starts = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        self.split = self.cut = None
        # a unigram model's sums are rounded from the text's start, and that decides between equal paths
        apart = self.merges and self.normal.escape and not self.normal.suffix and (BAR in self.id or bool(self.byte))
        if apart and not any(BAR in p.lstrip(BAR) for p in self.id):
            hard = "\n" if not any("\n" in p for p in self.id) and self.byte else ""
            letter = re.compile(r"[^\W\d_]").match
            # a mark that no piece has after a letter starts a new word there, so that words repeat more often
            after = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if letter(a)}
            marks = "".join(re.escape(c) for c in ".,;:!?%&$#*|" if c not in after) if self.byte else ""
            lone = rf"{BAR}*[^\W\d_]+(?=[{marks}{BAR}{hard}]|\Z)|" if marks else ""
            self.split = re.compile(rf"{lone}{BAR}*[^{BAR}{hard}]+|{BAR}+" + (f"|{hard}" if hard else "")).findall
            self.cut = re.compile(rf"(?<=[^{BAR}]){BAR}")
        self.out = [b"" if p.type == 3 else b" \xe2\x81\x87 " if p.type == 2 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(BAR, " ").encode() for p in model.pieces]
        self.borders: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.met = 0
        self.paths = _Paths(self.path)

    def merged(self, text: str) -> list[str]:
        """The model's merges on a short text: the best-ranked pair first, the leftmost of equals."""
        part, get, never = list(text), self.rank.get, np.inf
        ranks = [get(a + b, never) for a, b in zip(part, part[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(part[k - 1] + part[k], never)
            if k < len(ranks):
                ranks[k] = get(part[k] + part[k + 1], never)
        return part

    def border(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a; a is empty at the start."""
        if self.met > BORDERS:
            self.met = 0
            self.borders.clear()
        self.met += 1
        known = self.borders[a][b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _least_by_merges(self, word: str) -> list[int]:
        """Where the arc into each position of the least path to it starts, with the merge order as state."""
        n, ids, borders, endings = len(word), self.id, self.borders, self.endings
        last, back, after = [""] * (n + 1), [0] * (n + 1), [borders[""]]
        for j in range(1, n + 1):
            i = j - 1
            piece = word[i:j]
            while True:
                # a lone character is an arc even if no piece has it: its bytes stand for it
                if piece in ids or i == j - 1:
                    ok = after[i].get(piece)
                    if ok is None:
                        ok = self.border(last[i], piece)
                    if ok:
                        break
                i -= 1
                piece = word[i:j]
                if i < 0 or piece not in endings:
                    raise AssertionError(f"no path to position {j} of {word!r}")
            last[j], back[j] = piece, i
            after.append(borders[piece])
        return back

    def _least_by_scores(self, word: str) -> list[int]:
        """Where the arc into each position of the least path to it starts, by sums of the pieces' scores."""
        n, score, starts = len(word), self.score, self.starts
        total, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(n):
            here, alone, j = total[i], False, i + 1
            while j <= n and (piece := word[i:j]) in starts:
                by = score.get(piece)
                if by is not None:
                    if (reached := float(np.float32(here + by))) > total[j]:
                        total[j], back[j] = reached, i
                    alone |= j == i + 1
                j += 1
            if not alone and (reached := float(np.float32(here + self.missing))) > total[i + 1]:
                total[i + 1], back[i + 1] = reached, i
        return back

    def path(self, word: str) -> bytes:
        """Ids of the least path through the word's lattice, as 32-bit integers."""
        back = self._least_by_merges(word) if self.merges else self._least_by_scores(word)
        out, j, ids = [], len(word), self.id
        while j:
            i = back[j]
            piece = word[i:j]
            k = ids.get(piece)
            if k is not None:
                out.append(k)
            elif self.byte:
                out.extend(self.byte[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            elif not out or out[-1] != self.unknown:
                # a run of characters that no piece has is one unknown piece
                out.append(self.unknown)
            j = i
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        text, paths, out, at = self.normal(text), self.paths, [], 0
        if not text:
            return np.zeros(0, np.int32)
        if len(paths) > CACHE:
            paths.clear()
        if self.split is None:
            return np.frombuffer(self.path(text), np.int32)
        while at < len(text):
            m = self.cut.search(text, at + LONG)
            end = m.start() if m else len(text)
            out.extend(map(paths.__getitem__, self.split(text[at:end] if m or at else text)))
            at = end
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        if self.normal.suffix:
            return text[:-1] if self.normal.dummy and text.endswith(" ") else text
        return text[1:] if (self.normal.dummy or self.normal.squeeze) and text.startswith(" ") else text


_OPEN: dict[str, Transducer] = {}


def transduce(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, n_pieces, decoded) for each row of docs. path: a model file that every executor has."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if path not in _OPEN:
            _OPEN[path] = Transducer(path)
        fst = _OPEN[path]
        for batch in slices(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            ids = [None if t is None else fst.encode(t) for t in texts]
            size = [0 if x is None else len(x) for x in ids]
            flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), pa.int32(), mask=np.r_[[x is None for x in ids], False])
            back = [None if x is None else fst.decode(x) for x in ids]
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(size, pa.int64()), pa.array(back, pa.string())], ["id", "ids", "n_pieces", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, n_pieces long, decoded string").withColumnRenamed("id", id_col)

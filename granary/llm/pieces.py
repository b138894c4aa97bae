"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into words that no piece crosses; a batch's new words are encoded together, those of one length as one
matrix. All words of a length advance together by end position: substring hashes probe the sorted keys of the pieces and
of their beginnings, and the maxima over the pieces that may end there store backpointers.

* In a unigram model a piece gains its score.
* In a BPE model a step gains 0 if the piece may follow the last piece of what it continues, else it is ruled out. Two
  pieces may stand side by side if merging their text gives just these two; of all segmentations exactly one has only
  such neighbours, the one that the merges give. Whether two pieces may is read from how each was merged: of the last
  merges at the border, the later one is undone, until a merge across it would have come first, or single characters are left.
  This takes that a piece ranks after those it is merged of. A few don't (runs of blanks in the public model); words
  that hold the text of one are merged by rounds.

Merging by rounds, all words of a length at once, gives the pieces' own merges when a model is loaded, and is there as
another way to encode.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, carried, list_array, sized

SPACE = "▁"
#: Texts that are encoded together.
ROWS = 500
#: Multipliers of the two polynomial hashes (modulo 2 ** 64): the first finds a piece, the second confirms it.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def hashes(points: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of each row of a matrix of code points, and the powers of base."""
    n, length = points.shape
    b = np.uint64(base | 1)
    prefix, power = np.zeros((n, length + 1), "u8"), np.ones(length + 1, "u8")
    for i in range(length):
        prefix[:, i + 1] = prefix[:, i] * b + points[:, i].astype("u8") + np.uint64(1)
    power[1:] = np.cumprod(np.full(length, b, "u8"))
    return prefix, power


def between(hashed: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Both hashes of the substrings from start to end of rows."""
    return [prefix[rows, end] - prefix[rows, start] * power[end - start] for prefix, power in hashed]


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length)


def hashed_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of texts that aren't empty."""
    keys, confirm = np.zeros(len(texts), "u8"), np.zeros(len(texts), "u8")
    lengths = np.array([len(t) for t in texts])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        points = code_points([texts[r] for r in rows], n)
        keys[rows], confirm[rows] = (hashes(points, b)[0][:, -1] for b in BASES)
    return keys, confirm


@dataclass
class Pieces:
    """Pieces that can be merged or chosen, by sorted key; byte pieces; and what ids decode to."""

    texts: list[str]
    scores: np.ndarray
    ids: np.ndarray
    byte_ids: list[int]
    decoded: list[bytes]
    bpe: bool = True
    unknown: int = 0
    unknown_score: float = 0.0
    most: int = 300_000
    by_merges: bool = False

    def __post_init__(self) -> None:
        self.kept = Kept(self.most)
        joint = "".join(sorted({c for t in self.texts if len(t) > 1 for c in t} - {SPACE}))
        # A word: blanks, then characters that stand beside others in some piece. Any other character is a word.
        inside = f"[{re.escape(joint)}]" if joint else r"[^\s\S]"
        self.words = re.compile(f"{SPACE}*{inside}+|{SPACE}+|[^{SPACE}]", re.S)
        self.sizes = np.array([len(d) for d in self.decoded], "i8")
        self.blob = np.frombuffer(b"".join(self.decoded) or b"\0", "u1")
        self.offsets = np.cumsum(self.sizes) - self.sizes
        # Symbols: the pieces, and the single characters of pieces that are none themselves (id -1).
        single = sorted(({SPACE} | set(joint)) - set(self.texts)) if self.bpe else []
        texts = [*self.texts, *single]
        scores = np.concatenate([np.asarray(self.scores, "f8"), np.full(len(single), -np.inf)])
        ids = np.concatenate([np.asarray(self.ids, "i4"), np.full(len(single), -1, "i4")])
        lengths = np.array([len(t) for t in texts])
        self.longest = int(lengths.max(initial=1))
        keys, confirm = hashed_texts(texts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.confirm, self.scores, self.ids, self.lengths = keys[order], confirm[order], scores[order], ids[order], lengths[order]
        begins = sorted({t[:k] for t in texts for k in range(1, len(t) + 1)})
        keys, confirm = hashed_texts(begins)
        order = np.argsort(keys, kind="stable")
        self.begin_keys, self.begin_confirm = keys[order], confirm[order]
        self.begin_piece = self.probe(self.begin_keys, self.begin_confirm)
        if self.bpe:
            # Merge order: 0 for a character, then by score.
            self.rank = np.zeros(len(self.keys), "i4")
            several = np.flatnonzero(self.lengths > 1)
            self.rank[several[np.argsort(-self.scores[several], kind="stable")]] = np.arange(1, len(several) + 1)
            self._undo([t for t in texts if len(t) > 1])

    def _undo(self, texts: list[str]) -> None:
        """For each piece the two that its last merge joins, and its hashes; a piece that merging never gives is marked."""
        n = len(self.keys)
        self.left, self.right, self.reached = np.full(n, -1, "i4"), np.full(n, -1, "i4"), self.lengths == 1
        self.power = [np.ones(self.longest + 1, "u8") for _ in BASES]
        for power, base in zip(self.power, BASES, strict=True):
            power[1:] = np.cumprod(np.full(self.longest, base | 1, "u8"))
        by: dict[int, list[str]] = {}
        for t in texts:
            by.setdefault(len(t), []).append(t)
        for length, group in by.items():
            points = code_points(group, length)
            hashed = [hashes(points, b) for b in BASES]
            rows = np.arange(len(group))
            at = lambda r, a, b: self._lookup(hashed, r, np.full(len(r), a) if np.isscalar(a) else a, np.full(len(r), b) if np.isscalar(b) else b)
            for r, borders in self.merged(points, 2):
                if borders.shape[1] == 3:
                    whole = at(rows[r], 0, length)
                    self.left[whole], self.right[whole], self.reached[whole] = at(rows[r], 0, borders[:, 1]), at(rows[r], borders[:, 1], length), True
        early = {t for t, row in zip(texts, self.probe(*hashed_texts(texts)).tolist(), strict=True) if self.left[row] >= 0 and self.rank[row] <= max(self.rank[self.left[row]], self.rank[self.right[row]])}
        self.early = re.compile("|".join(map(re.escape, sorted(early)))) if early else None

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a SentencePiece model file, through the library that reads it."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts, scores, ids, decoded, byte_ids = [], [], [], [], [-1] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                decoded.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                texts.append(piece)
                scores.append(model.get_score(i))
                ids.append(i)
                decoded.append(piece.replace(SPACE, " ").encode())
        bpe = all(float(x).is_integer() for x in scores)  # minus the rank of its merge; a unigram model has log probabilities
        return cls(texts, np.array(scores), np.array(ids), byte_ids, decoded, bpe, model.unk_id(), min(scores, default=0.0) - 10)

    def probe(self, key: np.ndarray, confirm: np.ndarray) -> np.ndarray:
        """The pieces' rows for substring hashes; -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (self.confirm[at] == confirm), at, -1)

    def _lookup(self, hashed: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.probe(*between(hashed, rows, start, end))

    def merged(self, points: np.ndarray, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
        """BPE of words of one length: (rows, borders of their symbols) for each number of symbols left, which is at
        least the given one."""
        n, length = points.shape
        hashed = [hashes(points, b) for b in BASES]
        rows, borders = np.arange(n), np.tile(np.arange(length + 1), (n, 1))
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def score(r: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            short = end - start <= self.longest
            out = np.full(start.shape, -np.inf)
            if short.any():
                at = self._lookup(hashed, r[short], start[short], end[short])
                out[short] = np.where(at >= 0, self.scores[at], -np.inf)
            return out

        ranks = score(np.broadcast_to(rows[:, None], (n, length - 1)), borders[:, :-2], borders[:, 2:]) if length > 1 else np.zeros((n, 0))
        while ranks.shape[1] >= least:
            best = ranks.argmax(1)
            more = ranks[np.arange(len(rows)), best] > -np.inf
            if not more.all():
                done.append((rows[~more], borders[~more]))
                rows, borders, ranks, best = rows[more], borders[more], ranks[more], best[more]
                if not len(rows):
                    return done
            k, m = np.arange(len(rows)), ranks.shape[1]
            keep = np.ones(borders.shape, bool)
            keep[k, best + 1] = False
            borders = borders[keep].reshape(len(rows), m + 1)
            keep = np.ones(ranks.shape, bool)
            keep[k, best] = False
            ranks = ranks[keep].reshape(len(rows), m - 1)
            if m > 1:
                for off in (-1, 0):  # the pairs that the new symbol is in
                    has = (best + off >= 0) & (best + off < m - 1)
                    kk, at = k[has], best[has] + off
                    ranks[kk, at] = score(rows[has], borders[kk, at], borders[kk, at + 2])
        done.append((rows, borders))
        return done

    def may_follow(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging the text of piece u and piece t gives these two; -1 for u: at a word's start."""
        ok = np.ones(len(u), bool)
        at = np.flatnonzero(u >= 0)
        x, y = u[at], t[at]
        limit = np.full(len(at), np.iinfo("i4").max)
        while len(at):
            both = self.probe(*[k[x] * p[self.lengths[y]] + k[y] for k, p in zip((self.keys, self.confirm), self.power, strict=True)])
            crossed = (both >= 0) & (self.rank[both] < limit)
            ok[at[crossed]] = False
            later = self.rank[x] > self.rank[y]  # of the last merges at the border, the later one is undone
            more = ~crossed & ((self.rank[x] > 0) | (self.rank[y] > 0))
            # A merge across comes first if it ranks before the one at its left, or as the one at its right.
            limit = np.where(later, self.rank[x], self.rank[y] + 1)[more]
            x, y, at = np.where(later, self.right[x], x)[more], np.where(later, y, self.left[y])[more], at[more]
        return ok

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentation of words of one length: (row, piece) of each word's pieces in order, -1 for a character that is
        no piece and costs unknown_score."""
        n, length = points.shape
        hashed = [hashes(points, b) for b in BASES]
        best, back, last = np.full((n, length + 1), -np.inf), np.zeros((n, length + 1), "i4"), np.full((n, length + 1), -1, "i4")
        best[:, 0] = 0
        r, s = np.zeros(0, "i8"), np.zeros(0, "i8")  # where a piece may have begun
        for end in range(1, length + 1):
            r, s = np.concatenate([r, np.arange(n)]), np.concatenate([s, np.full(n, end - 1)])
            keys = between(hashed, r, s, np.full(len(r), end))
            at = np.minimum(np.searchsorted(self.begin_keys, keys[0]), len(self.begin_keys) - 1)
            begun = (self.begin_keys[at] == keys[0]) & (self.begin_confirm[at] == keys[1])
            piece = np.where(begun, self.begin_piece[at], -1)
            use = piece >= 0
            if self.bpe:
                use &= self.reached[piece]
                pairs, which = np.unique(last[r[use], s[use]].astype("i8") << 32 | piece[use], return_inverse=True)
                gain = np.where(self.may_follow(pairs >> 32, pairs & 0xFFFFFFFF), 0.0, -np.inf)[which]
            else:
                gain = self.scores[piece[use]]
            steps = np.full((n, min(end, self.longest)), -np.inf)
            found = np.full(steps.shape, -1, "i4")
            back_by = end - 1 - s[use]
            steps[r[use], back_by], found[r[use], back_by] = best[r[use], s[use]] + gain, piece[use]
            other = found[:, 0] < 0
            steps[other, 0] = best[other, end - 1] + self.unknown_score
            pick = steps.argmax(1)
            every = np.arange(n)
            best[:, end], back[:, end], last[:, end] = steps[every, pick], end - 1 - pick, found[every, pick]
            r, s = r[begun], s[begun]
        ends = np.zeros((n, length), bool)
        row, at = np.arange(n), np.full(n, length)
        while len(row):
            ends[row, at - 1] = True
            at = back[row, at]
            row, at = row[at > 0], at[at > 0]
        row, at = np.nonzero(ends)
        return row, last[row, at + 1]

    def by_rounds(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As viterbi() for a BPE model, by merging."""
        hashed = [hashes(points, b) for b in BASES]
        found = [(np.repeat(rows, borders.shape[1] - 1), self._lookup(hashed, np.broadcast_to(rows[:, None], (len(rows), borders.shape[1] - 1)), borders[:, :-1], borders[:, 1:]).ravel()) for rows, borders in self.merged(points)]
        row, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], piece[order]

    def learned(self, words: list[str]) -> pa.ListArray:
        """The ids of words, those of one length encoded at once."""
        lengths = np.fromiter(map(len, words), "i8", len(words))
        merged = np.array([self.bpe and (self.by_merges or (self.early is not None and bool(self.early.search(w)))) for w in words])
        spots, ids = [], []
        for length, rounds in sorted(set(zip(lengths.tolist(), merged.tolist(), strict=True))):
            group = np.flatnonzero((lengths == length) & (merged == rounds))
            step = max(1, 200_000 // length)
            for start in range(0, len(group), step):
                rows = group[start : start + step]
                row, piece = (self.by_rounds if rounds else self.viterbi)(code_points([words[i] for i in rows.tolist()], length))
                found = np.where(piece >= 0, self.ids[piece], -1)
                lacks = np.unique(row[found < 0])
                plain = ~np.isin(row, lacks)
                spots.append(rows[row[plain]])
                ids.append(found[plain])
                for k in lacks.tolist():
                    own = row == k
                    each = self._with_bytes(words[rows[k]], piece[own])
                    spots.append(np.full(len(each), rows[k]))
                    ids.append(each)
        spot, flat = np.concatenate(spots), np.concatenate(ids).astype("i4")
        order = np.argsort(spot, kind="stable")
        return list_array(np.bincount(spot, minlength=len(words)), flat[order])

    def _with_bytes(self, word: str, pieces: np.ndarray) -> np.ndarray:
        out: list[int] = []
        start = 0
        for p in pieces.tolist():
            end = start + (int(self.lengths[p]) if p >= 0 else 1)
            raw = word[start:end].encode("utf-8", "surrogatepass")
            out += [int(self.ids[p])] if p >= 0 and self.ids[p] >= 0 else [self.byte_ids[b] for b in raw] if self.byte_ids[0] >= 0 else [self.unknown]
            start = end
        return np.array(out, "i4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as 32-bit integers; of the empty text none. Arrow numbers the words and gathers their ids."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        if not len(coded):
            return [np.zeros(0, "i4") for _ in texts]
        found = self.kept.of(coded.dictionary, self.learned).take(coded.indices)
        cuts = found.offsets.to_numpy()[np.concatenate([[0], np.cumsum([len(x) for x in split])])].tolist()
        ids = found.values.to_numpy()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of lists of ids: bytes are gathered for the batch; the blank before a text's first word goes."""
        ids = np.concatenate(lists) if lists else np.zeros(0, "i4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        raw = self.blob[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("i8")].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [t.removeprefix(" ") for t in texts]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, tokens, n_tokens), a row per row of docs: the ids that SentencePiece gives the whole text; with carry,
    those columns instead of doc_id.

    A null or empty text has no tokens. Null ids are kept, repeated rows give equal rows, an empty table an empty result. A
    long text is encoded whole. An added name that a carried column has gets an underscore.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            for part in (s.column("x0") for s in sized(batch, "x0", rows=ROWS)):
                ids = pieces.encode([x or "" for x in part.to_pylist()])
                counts = np.array([len(x) for x in ids], "i8")
                yield len(part), [list_array(counts, np.concatenate(ids)), pa.array(counts)]

    if carry is None:
        docs, carry, text_col = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text"
    return carried(docs, [F.col(text_col)], carry, "tokens array<int>, n_tokens long", run)


def decode_pieces(encoded: DataFrame, model_path: str, tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text, n_tokens, ids_crc32) of rows (doc_id, tokens). A null list decodes to the empty text."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column(tokens_col)
                values = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
                lists = [values[a:b] for a, b in zip(column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist(), strict=True)]
                crcs = [zlib.crc32(x.tobytes()) for x in lists]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pieces.decode(lists), pa.string()), pa.array([len(x) for x in lists], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "text", "n_tokens", "ids_crc32"])

    return encoded.select("doc_id", tokens_col).mapInArrow(run, "doc_id long, text string, n_tokens long, ids_crc32 long")


def round_trips(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Encode, then decode what was encoded: (doc_id or the carried columns, tokens, n_tokens, ids_crc32, n_chars, round_trip).

    ids_crc32 is of the ids as little-endian 32-bit integers, n_chars counts the decoded text's code points, and round_trip is whether that text
    is the one encoded. It isn't for a text with U+2581, which SentencePiece decodes as a blank. Null texts count as
    empty; other cases as in encode_pieces.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            for part in sized(batch, "x0", rows=ROWS):
                texts = [x or "" for x in part.column("x0").to_pylist()]
                lists = pieces.encode(texts)
                back = pieces.decode(lists)
                counts = np.array([len(x) for x in lists], "i8")
                crcs = pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64())
                yield len(texts), [list_array(counts, np.concatenate(lists)), pa.array(counts), crcs, pa.array([len(x) for x in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)])]

    if carry is None:
        docs, carry, text_col = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text"
    return carried(docs, [F.col(text_col)], carry, "tokens array<int>, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean", run)

"""Language identification by cross-parsing entropy.

A suffix automaton is built of each language's training text. A text is parsed against it into phrases, each the
longest match from where it starts; a text in the automaton's language needs few. Phrases times the bits that point to
a place in the training text, over the characters parsed, estimate the cross entropy; the least one wins.

The automaton and the rule that starts a new phrase are one table (state, character) -> (state, phrase ended?), so that
numpy advances many texts and all languages by one character at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried

ENDED = 1 << 30
#: Texts are parsed in pieces of this many characters (a new phrase starts with each), however long they are.
PIECE = 1024


def simplified(text: str) -> str:
    """Lower case; anything but letters as one space between words."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton of all substrings of text; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[to] != length[at] + 1:
                clone = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = clone
                    at = link[at]
                link[to] = clone
                to = clone
            link[new] = to
        last = new
    return step


@dataclass
class Model:
    """languages, sorted; codes: of each code point (0 for no letter); table: next state times alphabet, ENDED added
    where a phrase ended; roots: the languages' start states; bits: a phrase's cost in each language."""

    languages: list[str]
    codes: np.ndarray
    alphabet: int
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def train(samples: dict[str, str], most_letters: int = 100, spread: int = 24) -> Model:
    """samples: training text by language, simplified. Letters beyond the most frequent ones share `spread` codes, by a
    hash of the letter, so that scripts of thousands of letters are told apart as well."""
    languages = sorted(samples)
    letters = [c for c, _ in sorted(Counter("".join(samples.values()).replace(" ", "")).items(), key=lambda x: (-x[1], x[0]))[:most_letters]]
    code = {" ": 0, **{c: i + 1 for i, c in enumerate(letters)}}
    other = len(letters) + 1
    spread = spread if any(c not in code for x in samples.values() for c in set(x)) else 1
    size = other + spread
    rare = lambda c: other + (ord(c) * 0x9E3779B1 >> 7) % spread
    codes = np.zeros(0x110000, "u1")
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            codes[point] = code[low[0]] if low[0] in code else rare(low[0])
    tables, roots, shift = [], [], 0
    for name in languages:
        step = suffix_automaton("".join(chr(code[c]) if c in code else chr(rare(c)) for c in samples[name]))
        n = len(step) + 1  # the last state: after a character that no phrase starts with
        nxt = np.full((n, size), -1, "i8")
        for s, to in enumerate(step):
            for c, t in to.items():
                nxt[s, ord(c)] = t
        start = np.where(nxt[0] >= 0, nxt[0], n - 1)
        table = np.where(nxt >= 0, nxt, start + 0)
        ended = nxt < 0
        ended[0] = False
        tables.append(((table + shift) * size + ENDED * ended).astype("i4"))
        roots.append(shift * size)
        shift += n
    bits = np.array([math.log2(max(len(samples[x]), 2)) for x in languages])
    return Model(languages, codes, size, np.concatenate(tables).ravel(), np.array(roots, "i4"), bits)


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language, and the characters parsed by text (0: no letter)."""
    lengths = np.array([len(t) for t in texts], "i8")
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = model.codes[points]
    of = np.repeat(np.arange(len(texts), dtype="i4"), lengths)
    # Keep a blank only between letters of a text: the first one after a letter, unless none follows.
    first = np.ones(len(codes), bool)
    first[1:] = of[1:] != of[:-1]
    before = np.concatenate([[0], codes[:-1]])
    keep = (codes > 0) | ((before > 0) & ~first)
    codes, of = codes[keep], of[keep]
    last = np.ones(len(codes), bool)
    last[:-1] = of[1:] != of[:-1]
    keep = (codes > 0) | ~last
    codes, of = codes[keep], of[keep]
    counts = np.bincount(of, minlength=len(texts))
    pieces = -(-counts // PIECE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(counts) - counts)[owner] + place * PIECE
    sizes = np.minimum(counts[owner] - place * PIECE, PIECE)
    order = np.argsort(-sizes, kind="stable")
    owner, starts, sizes = owner[order], starts[order], sizes[order]
    found = np.zeros((len(model.languages), len(owner)), "i4")
    if len(owner):
        padded = np.concatenate([codes, np.zeros(PIECE, "u1")])
        grid = np.ascontiguousarray(padded[starts[:, None] + np.arange(sizes[0])].T)
        state = np.repeat(model.roots[:, None], len(owner), axis=1)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for t in range(int(sizes[0])):
            n = active[t]
            got = model.table[state[:, :n] + grid[t, :n]]
            found[:, :n] += got >> 30
            state[:, :n] = got & (ENDED - 1)
        found += 1
    total = np.zeros((len(texts), len(model.languages)), "i8")
    np.add.at(total, owner, found.T)
    return total, counts


def training_texts(docs: DataFrame, holds: Column, id_col: str, text_col: str, label_col: str, documents: int, characters: int, per_document: int, in_all: int, least: int) -> dict[str, str]:
    """The sample to learn from, by language: of its documents the first ones in the order of a hash of the id.

    Bounded by the parameters: so many documents, so many characters of each from a place that the hash picks, so many a
    language, and so many in all, dealt equally. With very many labels those of the most documents are learned, `least`
    characters each.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    labelled = docs.filter(holds & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    at = F.pmod(F.xxhash64(key, F.lit("place")), F.greatest(F.char_length(text_col) - per_document + 1, F.lit(1)).cast("long")).cast("int") + 1
    piece = F.substr(F.col(text_col), at, F.lit(per_document))
    rows = labelled.select(F.col(label_col).alias("label"), F.xxhash64(key).alias("hash"), piece.alias("text"))
    counts = labelled.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(in_all // least).collect()
    characters = min(characters, in_all // max(len(counts), 1))
    documents = min(documents, -(-4 * characters // per_document) + 20)
    # Hashes below a language's cut are few, about four times the documents wanted, however large the corpus is.
    cuts = {r["label"]: min(2**63 - 1, int(-(2**63) + 4 * documents / r["n"] * 2**64)) for r in counts}
    cut = F.element_at(F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair]), F.col("label")) if cuts else F.lit(0)
    rank = Window.partitionBy("label").orderBy("hash", "text")
    rows = rows.filter(F.col("hash") <= cut).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= documents).orderBy("label", "rank")
    found: dict[str, str] = {}
    for r in rows.collect():
        had = found.get(r["label"], "")
        if len(had) < characters and (more := simplified(r["text"])):
            found[r["label"]] = f"{had} {more}".strip()[:characters]
    return {k: v for k, v in found.items() if v}


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", documents: int = 300, characters: int = 30_000, per_document: int = 600, in_all: int = 240_000, least: int = 240, carry: Sequence[str] | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, lang_pred, score), or with carry those columns, then these.

    Held out are documents whose crc32 of the id as text, modulo folds, is fold (a null id: of the empty text); the
    others' texts and labels may be learned from, within the sample that the parameters bound. Only the text
    enters a prediction. A null text, or one without a letter, is `und` with score 0; so is every text if nothing could be learned.
    score is one less the ratio of the least to the second least entropy, 1 with a single language; on equal entropies
    the name that sorts first wins and score is 0. Whole texts are parsed, however long. Any number of labels is allowed
    (see training_texts); other columns, whatever their names, come back if carried. Repeated rows get equal rows; an empty table gives an empty result.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = F.pmod(F.crc32(ident.cast("binary")), F.lit(folds)) == fold
    samples = training_texts(docs, ~held, id_col, text_col, label_col, documents, characters, per_document, in_all, least)
    model = train(samples) if samples else None
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # bounded by in_all characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
        model = Model(**shared.value) if shared.value else None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                for x in batch.column("x0").slice(at):
                    texts.append(x.as_py() or "")
                    size += len(texts[-1])
                    if size > 1_500_000:
                        break
                held_out = batch.column("x1").slice(at, len(texts))
                at += len(texts)
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                if model is not None:
                    count, parsed = phrases(model, texts)
                    cost = count * model.bits / np.maximum(parsed, 1)[:, None]
                    best = cost.argmin(1)
                    if len(model.languages) > 1:
                        two = np.partition(cost, 1, axis=1)
                        scores = np.where(parsed > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12), 0.0)
                    else:
                        scores = (parsed > 0).astype(float)
                    names = [model.languages[b] if p else "und" for b, p in zip(best, parsed, strict=True)]
                yield len(texts), [held_out, pa.array(names, pa.string()), pa.array(np.clip(scores, 0.0, 1.0))]

    if carry is None:
        docs, carry, inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held")), ["doc_id"], [F.col("text"), F.col("held")]
    else:
        inputs = [F.col(text_col), held]
    return carried(docs, inputs, carry, "held_out boolean, lang_pred string, score double", run)

"""Language identification with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, by a forward
algorithm over its characters; that of a text the product over its words. Pieces do
not reach over white space, so each distinct word is worked out once for all
languages and remembered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import pick

UNKNOWN = "und"
#: Letters of the longest piece of the vocabulary that is used.
PIECE = 16
#: Words that a worker remembers at most, and numbers for them; the memory starts anew beyond either.
REMEMBERED, NUMBERS = 800_000, 8_000_000
#: Numbers that the forward algorithm holds at once.
AT_ONCE = 4_000_000
#: Labelled rows of one language that are learned from at most, chosen by a hash of the text.
TRAIN_ROWS = 5_000
SMOOTHING = 0.1


def letters(word: str) -> str:
    """The word's letters in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Pieces:
    """The vocabulary: id by piece; letters outside it are spelled by their bytes."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.processor.get_piece_size()
        self.size = n
        self.ids = {p: k for k in range(n) if len(p := self.processor.id_to_piece(k)) <= PIECE and not self.processor.is_control(k) and not self.processor.is_unknown(k) and not self.processor.is_byte(k)}
        self.bytes = [self.processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

        # a trie of the pieces: (node, letter) in one sorted number, the node there, and its piece or -1
        nodes = {x: k for k, x in enumerate(dict.fromkeys(["", *(p[:k] for p in self.ids for k in range(1, len(p) + 1))]))}
        steps = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), k) for x, k in nodes.items() if x)
        self.steps, self.to = (np.array(x, dtype=np.int64) for x in zip(*steps, strict=True))
        self.piece = np.array([self.ids.get(x, -1) for x in nodes], dtype=np.int64)

    def cut(self, words: list[str]) -> list[list[int]]:
        """One segmentation of each word, to count pieces by."""
        return self.processor.encode(words, num_threads=1)


def forward(words: list[str], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Log-probability of each marked word under each language (columns of ``logs``), over all segmentations."""
    n = len(words)
    if not n:
        return np.zeros((0, logs.shape[1]))
    sizes = np.fromiter(map(len, words), np.int64, n)
    letter = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    word = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    start = np.arange(len(letter)) - (ends - sizes)[word]
    # from every letter at once, one step down the trie a round
    at, node = np.arange(len(letter)), np.zeros(len(letter), dtype=np.int64)
    single = np.zeros(len(letter), dtype=bool)
    edges = []
    for k in range(PIECE):
        inside = at + k < ends[word[at]]
        at, node = at[inside], node[inside]
        if not len(at):
            break
        key = node << 21 | letter[at + k]
        step = np.minimum(np.searchsorted(pieces.steps, key), len(pieces.steps) - 1)
        found = pieces.steps[step] == key
        at, node = at[found], pieces.to[step[found]]
        full = pieces.piece[node] >= 0
        edges.append((start[at[full]] + k + 1, start[at[full]], word[at[full]], pieces.piece[node[full]]))
        if k == 0:
            single[at[full]] = True
    # letters outside the vocabulary are spelled by their bytes
    odd = np.flatnonzero(~single)
    letters_, which = np.unique(letter[odd], return_inverse=True)
    table = np.vstack([logs, *[logs[[pieces.bytes[b] for b in chr(c).encode()]].sum(axis=0) for c in letters_.tolist()]])
    edges.append((start[odd] + 1, start[odd], word[odd], len(logs) + which))
    j, i, w, p = (np.concatenate([e[k] for e in edges]) for k in range(4))
    order = np.argsort(j * (PIECE + 1) + (j - i), kind="stable")
    j, i, w, p = j[order], i[order], w[order], p[order]
    # a piece reaches back by its letters only, so that many steps are held, in turn
    alpha, out = np.full((PIECE + 1, n, logs.shape[1]), -np.inf), np.zeros((n, logs.shape[1]))
    alpha[0], now = 0.0, 0
    by_size = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], (j[1:] != j[:-1]) | (i[1:] != i[:-1]))))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(j)], strict=True):  # a word has one edge from i to j
        if j[a] != now:
            out[ended] = alpha[now % (PIECE + 1), ended] if (ended := by_size[np.searchsorted(sizes, now, sorter=by_size) : np.searchsorted(sizes, now, "right", sorter=by_size)]).size else 0.0
            now = int(j[a])
            alpha[now % (PIECE + 1)] = -np.inf
        to, at = alpha[now % (PIECE + 1)], w[a:b]
        to[at] = np.logaddexp(to[at], alpha[i[a] % (PIECE + 1), at] + table[p[a:b]])
    ended = by_size[np.searchsorted(sizes, now, sorter=by_size) :]
    out[ended] = alpha[now % (PIECE + 1), ended]
    return out


def _count(model: str):
    """Rows ``lang, text`` -> rows ``lang, piece, n``: a task's pieces, each once a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = Pieces(model), {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.setdefault(lang, Counter()).update((text.as_py() or "").split())
            for lang, found in words.items():
                clean: Counter = Counter()
                for w, n in found.items():
                    clean[letters(w)] += n
                del clean[""]
                cuts = pieces.cut(list(clean))
                sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
                flat = np.fromiter((x for c in cuts for x in c), np.int64, int(sizes.sum()))
                counts.setdefault(lang, np.zeros(pieces.size))
                counts[lang] += np.bincount(flat, np.repeat(np.array(list(clean.values()), dtype=float), sizes), pieces.size)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(found[at].astype(np.int64), pa.int64())], ["lang", "piece", "n"])

    return run


def train(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", model: str, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each piece (row) in each (column).

    Learned from about ``rows`` rows of each language, those whose text has the
    smallest hashes; all rows of a language that has fewer. At most vocabulary x
    languages numbers come to the driver, 256 kB a language. Rows without a language
    are not learned from; null text has no words; rows of equal text are taken or left
    together. An empty table gives no languages.
    """
    src = pick(df, lang=lang_col, text_=text_col).where("lang is not null").select(F.col("lang").cast("string"), F.col("text_").cast("string"))
    many = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > rows).collect()}
    if many:
        part = F.coalesce(F.element_at(F.create_map(*[x for lang, n in many.items() for x in (F.lit(lang), F.lit(rows / n))]), F.col("lang")), F.lit(1.0))
        src = src.where(F.pmod(F.xxhash64("text_"), F.lit(1 << 20)) < part * (1 << 20))
    counts = src.mapInArrow(_count(model), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    table = np.full((Pieces(model).size, len(langs)), SMOOTHING)
    column = {x: k for k, x in enumerate(langs)}
    table[found["piece"].to_numpy(), [column[x] for x in found["lang"].to_pylist()]] += found["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)) if langs else table


def predict(df: DataFrame, langs: list[str], logs: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", model: str) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``; ``score`` is the language's
    part of the probability of the text, all languages being as likely before.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned. Equal languages go to the first by name. An empty table gives no rows.
    """
    # what a worker has learned about words stays with its copy of the broadcast
    shared = df.sparkSession.sparkContext.broadcast({"logs": logs})
    src = pick(df, doc_id=id_col, text_=text_col).select("doc_id", F.col("text_").cast("string"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = shared.value
        logs = memory["logs"]
        if "pieces" not in memory:
            memory |= {"pieces": Pieces(model), "known": {}, "clean": {}, "scores": np.zeros((1, logs.shape[1] + 1))}
        pieces = memory["pieces"]
        for batch in batches:
            texts = [(t.as_py() or "").split() for t in batch.column(1)]
            if len(memory["known"]) > REMEMBERED or memory["scores"].size > NUMBERS:
                memory |= {"known": {}, "clean": {}, "scores": np.zeros((1, logs.shape[1] + 1))}
            known, clean = memory["known"], memory["clean"]
            fresh = {w: letters(w) for words in texts for w in words if w not in known}
            new = list({c for c in fresh.values() if c and c not in clean})
            step = max(1, AT_ONCE // ((PIECE + 1) * max(1, logs.shape[1])))
            new.sort(key=len)
            for at in range(0, len(new), step):
                some = new[at : at + step]
                value = np.zeros((len(some), logs.shape[1] + 1))
                value[:, :-1] = forward(["▁" + c for c in some], pieces, logs)
                value[:, -1] = 1.0  # it has a letter
                clean.update(zip(some, range(len(memory["scores"]), len(memory["scores"]) + len(some)), strict=True))
                memory["scores"] = np.concatenate([memory["scores"], value])
            known.update((w, clean.get(c, 0)) for w, c in fresh.items())  # row 0: no letter
            scores = memory["scores"]
            out_lang, out_score = [], []
            for words in texts:
                total = scores[[known[w] for w in words]].sum(axis=0) if words else np.zeros(logs.shape[1] + 1)
                if not total[-1] or not langs:
                    out_lang.append(UNKNOWN)
                    out_score.append(0.0)
                else:
                    best = int(np.argmax(total[:-1]))
                    out_lang.append(langs[best])
                    out_score.append(float(1.0 / np.exp(total[:-1] - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")

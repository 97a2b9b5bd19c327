"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities of the pieces of a fixed public vocabulary.  A
word (a run of letters, lower-cased, with the vocabulary's word mark before it)
can be cut into pieces in many ways; its probability in a language is the sum
over all of them, by a forward algorithm.  A character that is no piece is cut
into the vocabulary's byte pieces.  A text's score in a language is the sum of
its words' log probabilities, repeats included; all languages are as likely
beforehand.

Piece probabilities are counts over all learning documents, each word cut by the
vocabulary's own rule, with add-``SMOOTH`` smoothing over the whole vocabulary.
The model has languages x pieces numbers, whatever the corpus.

Results for odd input: a text that is null or has no letter is ``und`` with
score 0, and so is every text if no document can be learned from; a document
without doc_id is not held out and not learned from; repeated rows count; an
empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domquarry.llm.tokens import worker_state

FOLDS = 5
SMOOTH = 0.1
UNKNOWN = "und"
MARK = "▁"
#: Bytes of words, with their scores, that a worker remembers before it starts anew, and of an entry besides its letters.
MEMO, ENTRY_BYTES = 96 << 20, 160
#: Below this a probability is summed by logarithms.
SAFE_LOG = -600.0
#: Documents whose words a task holds at once.
CHUNK = 1024
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or _letters(w)] if text else []


def _letters(word: str) -> bool:
    """Numerals such as superscripts are in the pattern but are no letters."""
    return any(c.isalpha() for c in word)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; null without doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Vocabulary:
    """The pieces of a sentencepiece model with byte pieces."""

    def __init__(self, model: bytes):
        self.cut = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.cut.get_piece_size()
        self.bytes, self.ids = np.zeros(256, np.int64), {}
        for i in range(self.size):
            piece = self.cut.id_to_piece(i)
            if self.cut.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (self.cut.is_control(i) or self.cut.is_unknown(i) or self.cut.is_unused(i)):
                self.ids[piece] = i
        self.longest = max(map(len, self.ids), default=1)


class Model:
    """Scores words: ``table`` has the log probability of each piece (row) in each language."""

    def __init__(self, vocabulary: Vocabulary, table: np.ndarray):
        self.vocabulary, self.table, self.plain = vocabulary, table, np.exp(table)

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities (word, language): for words of equal length all at once."""
        out = np.empty((len(words), self.table.shape[1]))
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for same in by_length.values():
            for at in range(0, len(same), 4096):
                rows = same[at:at + 4096]
                out[rows] = self._forward([MARK + words[i] for i in rows])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words of one length: by plain sums, and again by
        sums of logarithms where a word's probability is too small for those."""
        with np.errstate(divide="ignore"):
            out = np.log(self._sums(words, self.plain, np.add, np.multiply, 1.0, 0.0))
        small = np.flatnonzero((out < SAFE_LOG).any(axis=1))
        if len(small):
            out[small] = self._sums([words[i] for i in small], self.table, np.logaddexp, np.add, 0.0, -np.inf)
        return out

    def _sums(self, words: list[str], table: np.ndarray, plus, times, one: float, zero: float) -> np.ndarray:
        """The forward algorithm in the semiring (plus, times)."""
        find, longest, n = self.vocabulary.ids.get, self.vocabulary.longest, len(words[0])
        shape = len(words), table.shape[1]
        states = [np.full(shape, one)]  # of the last ends: all ways to cut the characters before
        for end in range(1, n + 1):
            here = np.full(shape, zero)
            for back in range(min(end, longest), 0, -1):
                ids = [find(w[end - back:end], -1) for w in words]
                if max(ids) >= 0:
                    ids = np.array(ids)
                    rows = np.flatnonzero(ids >= 0)
                    here[rows] = plus(here[rows], times(states[-back][rows], table[ids[rows]]))
                if back == 1:
                    for r in np.flatnonzero(np.less(ids, 0)).tolist():
                        way = states[-1][r]
                        for b in words[r][end - 1].encode("utf-8", "surrogatepass"):
                            way = times(way, table[self.vocabulary.bytes[b]])
                        here[r] = plus(here[r], way)
            states = [*states[-longest + 1:], here] if longest > 1 else [here]
        return states[-1]


def learn(docs: DataFrame, model_bytes: bytes, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (piece, language) from ``docs`` (lang,
    text), which are all learned from."""
    def count(batches):
        vocabulary, words, pieces, held = Vocabulary(model_bytes), defaultdict(Counter), defaultdict(Counter), 0

        def spend():
            for lang, own in words.items():
                for n, ids in zip(own.values(), vocabulary.cut.encode(list(own), num_threads=1)):
                    for i in ids:
                        pieces[lang][i] += n
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = letter_words(text)
                words[lang].update(own)
                held += sum(map(len, own))  # repeats count as well
                if held >= MEMO // 4 or sum(map(len, words.values())) >= MEMO // (4 * ENTRY_BYTES):
                    spend()
                    held = 0
        spend()
        for lang in pieces:
            if pieces[lang]:
                ids, n = zip(*pieces[lang].items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(ids)), pa.array(ids, pa.int32()), pa.array(n, pa.int64())],
                    ["lang", "piece", "n"])

    counts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(
        count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # at most languages x pieces rows
    languages = sorted({r["lang"] for r in rows})
    table = np.full((sentencepiece.SentencePieceProcessor(model_proto=model_bytes).get_piece_size(),
                     len(languages)), smooth)
    column = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        table[r["piece"], column[r["lang"]]] += r["n"]
    return languages, np.log(table / table.sum(axis=0)) if languages else table


def predict(docs: DataFrame, model_bytes: bytes, languages: list[str], table: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text, held_out) with lang_pred and score, the
    probability of the language given the text, instead of text."""
    small = table.astype(np.float32)  # languages x pieces numbers go with the task code

    key = hash((small.tobytes(), model_bytes))

    def run(batches):
        state = worker_state()  # a later task of this worker goes on with its model and words
        if getattr(state, "languages", (None,))[0] != key:
            state.languages = key, Model(Vocabulary(model_bytes), small.astype(float)), {}, [], [0]
        _, model, memo, parts, held = state.languages
        scores = np.concatenate(parts) if parts else np.empty((0, len(languages)))
        for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
            found = [letter_words(t) if languages else [] for t in batch.column("text").to_pylist()]
            if held[0] > MEMO:
                memo.clear()
                scores, held[0] = scores[:0], 0
            new = list(dict.fromkeys(w for ws in found for w in ws if w not in memo))
            memo.update(zip(new, range(len(memo), len(memo) + len(new))))
            held[0] += sum(map(len, new)) * 2 + len(new) * (ENTRY_BYTES + 8 * len(languages))
            scores = np.concatenate([scores, model.words(new)])
            parts[:] = [scores]
            lang, score = [], []
            for ws in found:
                if not ws:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total = scores[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax())
                lang.append(languages[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = docs.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def identified(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text,
    lang); learned from the rows with a language that are not held out."""
    with open(vocabulary_path, "rb") as f:
        model_bytes = f.read()
    part = fold(F.col("doc_id"))
    languages, table = learn(docs.filter(part != 0), model_bytes)
    asked = docs.select("doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held_out"))
    return predict(asked, model_bytes, languages, table)

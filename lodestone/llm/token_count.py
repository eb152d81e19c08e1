"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place of a word;
a Viterbi pass carries, for each place, only the best score and the number of pieces
on its path. Ties go as in the tokenizers library: a later candidate must be strictly
better, and candidates come by rising start. Words are cut before each space mark, as
the library's Metaspace pre-tokenizer does (so the few pieces with a mark inside, runs of
marks, never match), and a text's count is the sum over its words; counts of words
seen before come from a bounded cache.

The installed vocabulary files hold no unigram model and tokenizers are not trained
here; the query takes pieces and scores of the sentence-piece file as one (``token_counts``
takes any), and is exact for the library's unigram model with these.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import slices

MARK = "▁"
#: Fixed value of the tokenizers library: an unknown character scores the least piece score minus this.
UNKNOWN_PENALTY = 10.0


def pieces_of(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces with scores, the unknown piece's id, and whether unknown characters fall back to byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    vocab = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(n)]
    return vocab, model.unk_id(), any(model.is_byte(i) for i in range(n))


class Counter(dict):
    """Counts of words (without their space mark), computed when missing; emptied when full."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool, cached: int = 300_000):
        super().__init__()
        self.cached, self.byte_fallback = cached, byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= self.cached:
            self.clear()
        self[word] = got = self.count(MARK + word)
        return got

    def count(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ending[last + 1].append(match)
        score, pieces, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best, found, short = None, 0, False
            for length, s in sorted(ending[end], reverse=True):  # by rising start
                if best is None or s + score[end - length] > best:
                    best, found = s + score[end - length], pieces[end - length] + 1
                short |= length == 1
            unknown = False
            if not short:
                s = self.unknown + score[end - 1]
                if best is None or s > best:
                    best, unknown = s, True
                    if self.byte_fallback:
                        found = pieces[end - 1] + len(word[end - 1].encode())
                    else:  # neighbouring unknown characters are one piece
                        found = pieces[end - 1] + (not fused[end - 1])
            score[end], pieces[end], fused[end] = best, found, unknown
        return pieces[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = (marked[1:] if marked[0] == MARK else marked).split(MARK)
        return sum(map(self.__getitem__, words))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of each whole text. Null and empty texts have 0 tokens; rows are independent; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            vocab, _, fallback = pieces_of(path)
            _COUNTERS[path] = Counter(vocab, fallback)
        count = _COUNTERS[path].text
        for batch in slices(batches):
            n = pa.array([count(t or "") for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")

"""Token counts of documents by the whole-token shortcut.

A model whose pieces never hold a word boundary mark after another character
can't merge across that mark, so a text's count is the sum over its words. It
is proved once, on the driver, which vocabulary strings encode alone as one
token: these count as one without any merging. Only other words are merged, by
the library itself, and their counts are kept in a bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.llm import common

MARK = "▁"
#: Words of which a task keeps the count at once, and their greatest length.
KEPT_WORDS, KEPT_LENGTH = 400_000, 64

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(model: bytes) -> frozenset[str] | None:
    """Words that encode alone as exactly one token; None if the model may merge across words.

    Word w stands for the piece MARK + w. Proof that words are independent: no
    piece holds the mark after another character, so no merge joins a mark to
    what precedes it, and the model changes no character before merging.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(model)
    norm = spec.normalizer_spec
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [p.piece for p in spec.pieces]
    merges_across = any(MARK in p.lstrip(MARK) for p in pieces) or spec.trainer_spec.treat_whitespace_as_suffix
    # no user-defined symbol (type 4): these are cut out of a text before merging
    keeps = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and all(p.type != 4 for p in spec.pieces)
    if merges_across or not keeps:
        return None
    words = [(i, p[1:]) for i, p in enumerate(pieces) if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    alone = sp.encode([w for _, w in words])
    return frozenset(w for (i, w), ids in zip(words, alone, strict=True) if ids == [i])


def text_counter(model: bytes, whole: frozenset[str] | None):
    """A function from text to its number of tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)

    class Counts(dict):
        def __missing__(self, word: str) -> int:
            n = len(sp.encode(word))
            if len(word) <= KEPT_LENGTH:
                if len(self) >= KEPT_WORDS:
                    self.clear()
                    self.update(start)
                self[word] = n
            return n

    start = dict.fromkeys(whole or (), 1)
    of = Counts(start).__getitem__

    def count(text: str | None) -> int:
        if not text:
            return 0
        # runs of spaces are pieces of their own, and the mark itself in a text stands for a space
        if whole is None or "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return len(sp.encode(text))
        return sum(map(of, text.split(" ")))

    return count


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, columns of keep, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    No begin, end or added special tokens; special strings inside a text are
    ordinary text. A null or empty text has 0 bytes and 0 tokens; a very long one is counted whole. Repeated rows
    and null ids give a row each; columns not in keep are not read. An empty table
    gives an empty table.
    """
    common.bound_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))  # a vocabulary file: bounded
    source = docs.select(id_col, text_col, *keep)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = None
        for b in batches:
            count = count or text_counter(*shared.value)
            text = b.column(1)
            n = pa.array([count(t) for t in text.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(2 + k) for k in range(len(keep))), size, n, pc.greater(n, limit)], [id_col, *keep, "n_bytes", "n_tokens", "over_limit"])
        common.release()

    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + [SCHEMA]))

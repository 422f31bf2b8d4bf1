"""Token counts under a fixed unigram vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellsift.llm.lattice import Pieces, load_pieces, rank_log_probs, word_piece_counts
from cellsift.llm.text import distinct, slices, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: one row (id, n_words, n_tokens) per row of ``docs``.

    Pre-tokens are the words between ASCII white space, each with the word mark in front. The distinct pre-tokens
    of a run of texts go into a trie; the best unigram score is computed once per shared prefix, and each terminal
    node holds the piece count of its word. Scores come from the ranks that the vocabulary file gives (Zipf's law);
    a character may also be spelled by its bytes. Equal scores take the fewer pieces.

    Null and empty texts have no words and no tokens. Repeated rows are counted each. Other columns are not read.
    Nothing is shuffled; a worker holds 8 MB of text at a time, or one longer text.
    """
    pieces = load_pieces(vocabulary)
    logp = rank_log_probs(len(pieces))

    def count(batches):
        table = Pieces(pieces, logp)
        for part in slices(batches):
            flat, doc, n_words = words(part.column(1))
            vocab, codes = distinct(flat)
            counts = word_piece_counts(vocab, table)
            n_tokens = np.bincount(doc, counts[codes] if len(codes) else None, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_tokens.astype(np.int64))],
                names=[id_col, "n_words", "n_tokens"],
            )

    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(id_col, docs[text_col].alias("text") if text_col != "text" else text_col).mapInArrow(count, schema)

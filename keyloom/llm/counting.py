"""Token counts by a compiled counting transducer whose chunk maps compose in a prefix scan.

The vocabulary's merge list is compiled to a deterministic transducer (:mod:`keyloom.llm.transducer`): transitions by bytes,
each annotated with the number of tokens that it emits. White space and pre-tokens' last bytes lead back to the start state.
A batch of texts is one sequence of symbols, cut into ``LANES`` chunks anywhere. All chunks' maps, from entry state to exit
state and emitted count, are made side by side and composed from left to right; counting a text is adding up the annotations
of its transitions. There is one path for all texts, and ids are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import encoder
from .common import map_texts


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, **cols: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per document.

    Null and empty texts have no bytes and no tokens; texts of any length are read in blocks; a text of exactly ``limit``
    tokens is not over it. Repeated rows give repeated rows, an empty table none. Columns beside the two that are read do not
    matter, also where their names differ from these only in case.
    """

    def rows(batch: list[bytes]) -> list[list]:
        n = encoder(vocabulary).count([raw.decode("utf-8", "replace") for raw in batch])
        return [[len(raw) for raw in batch], n, n > limit]

    return map_texts(docs, "n_bytes long, n_tokens long, over_limit boolean", rows, **cols)

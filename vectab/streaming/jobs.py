"""Incremental embedding and search over arriving files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import keyed_vectors, row_bound, topk_join
from ..operators.embed import HASH_MODEL, embed, filter_unembedded
from ..plans.scaling import cut_lineage
from ..sources.store import Store, new_rows, upsert

ERRORS = "embedErrors"


def stream_embed(
    stream: DataFrame, store: Store, name: str, key: str, fields: Sequence[str], order_by: str,
    checkpoint: str, model: str = HASH_MODEL, available_now: bool = True, tries: int = 3, errors: str = ERRORS,
) -> StreamingQuery:
    """Import a stream of rows: skip known keys, embed the new, append them to the table.

    A batch that is replayed after a failure finds its keys in the table and adds
    nothing, so the sink is idempotent. Rows on which the model failed in an earlier
    batch are embedded again, up to ``tries`` times in all, which is the one case that rewrites the table; the
    number of failures and the last message stay in the column ``errors``.
    """

    def take(arrived: DataFrame, _: int) -> None:
        batch = cut_lineage(arrived)  # read the source once, and know the batch's size
        if store.exists(name):
            known = store.read(name)
            pending = filter_unembedded(known, model, errors=errors, tries=tries)
            fresh = embed(new_rows(known, batch, key, [order_by]), fields, model, errors=errors)
            if pending.isEmpty():
                store.append(name, fresh)  # the usual case: the table is not rewritten
            else:
                ready = cut_lineage(embed(pending, fields, model, errors=errors).unionByName(fresh, allowMissingColumns=True))
                store.write(name, upsert(known, ready, key, [order_by]), key)
        else:
            first = new_rows(batch.limit(0), batch, key, [order_by])
            store.write(name, embed(first, fields, model, errors=errors), key)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_search(
    queries: DataFrame, table: DataFrame, query_key: str, query_vector: str, key: str, vector: str,
    k: int, path: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Answer arriving query vectors against a stored table; hits go to Parquet.

    Each batch writes to its own folder below ``path``, so a replayed batch
    replaces its own output.
    """
    stored, n_stored = keyed_vectors(table, key, vector, "r"), row_bound(table)

    def answer(batch: DataFrame, number: int) -> None:
        asked = keyed_vectors(batch, query_key, query_vector, "l")
        hits = topk_join(asked, stored, k, sizes=(row_bound(batch), n_stored))
        hits.select(
            F.col("l_key").alias("query"), F.col("r_key").alias("hit"), "score", "rank"
        ).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Games -> record text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.functions import columns as C


def record_text(games: DataFrame, tags: str | None = "tags", start_state: str | None = "start_state") -> DataFrame:
    """(id, record): annotated games keep their movetext, the others get it from their moves."""
    heads = C.headers(
        event="event", site="site", date="date", round="round", white="white", black="black", result="result",
        white_elo="white_elo", black_elo="black_elo", eco="eco", opening="opening",
        tags=C.json_tags(tags) if tags else None, start_state=start_state,
    )
    first = C.start_ply(start_state) if start_state else F.lit(0)
    plain = C.wrap(C.movetext_of("sans", C.result_text("result"), first))
    return games.select("id", C.format_record(heads, F.coalesce("movetext", plain)).alias("record"))


def export_pgn(records: DataFrame, path: str) -> None:
    """Write records in id order: files are ranges of ids, in file order, with no single writer."""
    records.orderBy("id").select("record").write.mode("overwrite").option("lineSep", "\n").text(path)


def export_ids(ids: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Records of a list of ids, in the list's order. The list is a frame of ``pos`` and ``id`` (text or number) of any
    length. Texts that are not whole numbers and unknown ids drop out.
    """
    text = F.trim(F.col("id").cast("string"))
    whole = ids.select("pos", F.when(text.rlike(r"^\d+$"), text).try_cast("bigint").alias(key)).filter(F.col(key).isNotNull())
    return whole.join(records, key).orderBy("pos")

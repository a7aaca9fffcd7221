"""Named games -> star schema: games with ids, and the dimensions they point at."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludograph.operators.dims import build_dim, names_of, opening_dim, resolve_dims
from ludograph.operators.search import with_names


@dataclass(frozen=True)
class Star:
    games: DataFrame
    players: DataFrame
    events: DataFrame
    sites: DataFrame
    openings: DataFrame


def to_star(games: DataFrame, seq: str = "id") -> Star:
    """Build the four dimensions in order of first appearance and swap names for their ids."""
    dims = {
        "players": build_dim(names_of(games, ["white", "black"], seq)).select("id", "name"),
        "events": build_dim(names_of(games, ["event"], seq)).select("id", "name"),
        "sites": build_dim(names_of(games, ["site"], seq)).select("id", "name"),
    }
    if "opening_eco" not in games.columns:
        games = games.withColumn("opening_eco", F.col("eco"))
    openings = opening_dim(games.withColumn("seq", F.col(seq)), "seq")
    facts = resolve_dims(games.drop("opening_eco"), [
        ("white", dims["players"], "white_id"), ("black", dims["players"], "black_id"),
        ("event", dims["events"], "event_id"), ("site", dims["sites"], "site_id"),
    ])
    ids = openings.select(F.col("name").alias("opening"), F.col("id").alias("opening_id"))
    return Star(facts.join(ids, "opening", "left").drop("opening"), dims["players"], dims["events"], dims["sites"], openings)


def from_star(star: Star) -> DataFrame:
    """Names back in place of ids."""
    return with_names(star.games, star.players, star.events, star.sites, star.openings)

"""Seeded sources: questions about small invented worlds, mock answers to them, and calls of a simulated endpoint.

Every value is a hash of seed, name and row, so rows are the same in any order and again if a task is lost. Solvers read the text alone, never the
numbers that it was made from, so that they check the labels independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import parsing
from gaugeworks.functions import scalars as S

TOWNS = ("Arlen", "Brook", "Calder", "Dunmore", "Elling", "Fenwick", "Garth", "Holm")
FAMILIES = ("lookup", "routing", "chain", "window", "unstated", "base_rate")


def drawn(seed: str, name: str, row: Column, below: int) -> Column:
    """A number from 0 to below - 1 of a row."""
    return S.hash_draw(F.lit(below).cast("long"), F.lit(seed), F.lit(name), row)


def routed(days: Column, amount: Column, gold: Column, damaged: Column) -> Column:
    """The rule that routing questions are about: a person sees what is damaged, members of the gold tier have wider limits."""
    within = F.when(gold, (days <= 60) & (amount <= 500)).otherwise((days <= 30) & (amount <= 200))
    return F.when(damaged, "escalate").when(within, "approve").otherwise("deny")


def items(rows: DataFrame, row: str, seed: str) -> DataFrame:
    """One question for each row number: item, family, state, question, gold."""
    r = F.col(row)
    n = lambda name, below: drawn(seed, name, r, below)
    town = lambda name: F.element_at(F.array(*map(F.lit, TOWNS)), (n(name, len(TOWNS)) + 1).cast("int"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    firm = lambda k: text("Firm", r, F.lit("abc"[k]))
    days, amount, tier, damaged = n("days", 91), n("amount", 601), n("tier", 2) == 1, n("damaged", 5) == 0
    gap, day = n("gap", 61), n("day", 30) + 1
    date = lambda d: text(F.format_string("%04d-%02d-%02d", F.lit(2001), ((d - 1) / 30).cast("int") + 1, (d - 1) % 30 + 1))
    people = [text(F.lit(f"P{k}x"), r) for k in range(4)]
    red, blue = n("red", 9) + 1, n("blue", 9) + 1
    worlds = {
        "lookup": (text(*[x for k in range(3) for x in (firm(k), " has its seat in ", town(f"town{k}"), ".\n")]), firm(1), town("town1")),
        "routing": (
            text("age: ", days, "\namount: ", amount, "\ntier: ", F.when(tier, "gold").otherwise("plain"), "\ndamaged: ", F.when(damaged, "yes").otherwise("no")),
            F.lit("what happens"), routed(days, amount, tier, damaged),
        ),
        "chain": (text(*[x for k in (2, 0, 1) for x in (people[k], " answers to ", people[k + 1], ". ")]), people[0], people[3]),
        "window": (text("ordered ", date(day), ", sent back ", date(day + gap)), F.lit("within 30 days"), F.when(gap <= 30, "yes").otherwise("no")),
        "unstated": (text("Find ", r, " was dug up in ", town("dug"), "."), F.lit("made of"), F.lit("not_stated")),
        "base_rate": (text(red, " red and ", blue, " blue"), F.lit("red likelier"), F.when(red > blue, "yes").otherwise("no")),
    }
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (r % len(FAMILIES) + 1).cast("int"))
    world = F.coalesce(*[F.when(family == f, F.struct(s.alias("state"), q.alias("question"), g.alias("gold"))) for f, (s, q, g) in worlds.items()])
    return rows.select(r.alias("item"), family.alias("family"), world.alias("w")).select("item", "family", "w.state", "w.question", "w.gold")


def solved(given: DataFrame) -> DataFrame:
    """items with the answer that their text gives."""
    state, question = F.col("state"), F.col("question")
    record, when = parsing.registry(state), parsing.dates(state)
    seat = F.filter(parsing.edges(state, " has its seat in "), lambda x: x["a"] == question)
    count = lambda c: F.regexp_extract(state, rf"(\d+) {c}", 1).cast("int")
    answers = {
        "lookup": F.get(seat, F.lit(0))["b"],
        "routing": routed(record["age"].cast("int"), record["amount"].cast("int"), record["tier"] == "gold", record["damaged"] == "yes"),
        "chain": parsing.end_of_chain(parsing.edges(state, " answers to "), question),
        "window": F.when(F.get(when, F.lit(1)) - F.get(when, F.lit(0)) <= 30, "yes").otherwise("no"),
        "unstated": F.when(state.contains("made of"), F.regexp_extract(state, r"made of (\w+)", 1)).otherwise("not_stated"),
        "base_rate": F.when(count("red") > count("blue"), "yes").otherwise("no"),
    }
    return given.withColumn("answer", F.coalesce(*[F.when(F.col("family") == f, a) for f, a in answers.items()]))


def mocked(given: DataFrame, seed: str, percent: int) -> DataFrame:
    """items with predictions of a mock that is right for about so many in a hundred, and silent for one in fifty."""
    right = drawn(seed, "right", F.col("item"), 100) < percent
    return given.withColumn("prediction", F.when(drawn(seed, "silent", F.col("item"), 50) > 0, F.when(right, F.col("gold")).otherwise("other")))


def calls(rows: DataFrame, row: str, seed: str, floor_ms: float = 70.0, ms_a_token: float = 0.0625, failing: int = 3) -> DataFrame:
    """One call for each row number: call, tokens, status, latency_ms. Latency is a floor, a slope in tokens and a jitter; of a hundred calls some fail."""
    r = F.col(row)
    tokens = drawn(seed, "tokens", r, 2000) + 100
    return rows.select(
        r.alias("call"), tokens.alias("tokens"), F.when(drawn(seed, "fail", r, 100) < failing, "error").otherwise("ok").alias("status"),
        (F.lit(floor_ms) + F.lit(ms_a_token) * tokens + drawn(seed, "jitter", r, 32) / 4.0).alias("latency_ms"),
    )

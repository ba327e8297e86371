"""Readings: decisions, digit labels, id sets, strict JSON, costs, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Why a note is ignored or flagged (fixed values).
IGNORED = "not a number to either reader"
NO_TEMPLATE, BAD_REREAD, DISAGREES = "no template reading", "re-read invalid", "re-read disagrees with the template"


def first_decision(model: str, valid: str, template: str, digits: str | None = None) -> Column:
    """verified, ignored or reread (PRJ-17). Both readers must give the same
    number, of as many digits as the note has boxes (column ``digits``, if
    given). A valid 'not a number' is ignored only if the template has no reading."""
    m, v, t = F.col(model), F.coalesce(F.col(valid), F.lit(False)), F.col(template)
    fits = F.length(m.cast("string")) == F.col(digits) if digits else F.lit(True)
    return F.when(v & m.isNotNull() & (m == t) & fits, "verified").when(v & m.isNull() & t.isNull(), "ignored").otherwise("reread")


def final_decision(model: str, template: str, reread: str, reread_valid: str) -> tuple[Column, Column, Column]:
    """(status, fret, reason) of a note that was read again (PRJ-18): verified
    only if the second read agrees with the template, else flagged, showing the
    first reading there is of second read, template and first read."""
    m, t, r, v = F.col(model), F.col(template), F.col(reread), F.coalesce(F.col(reread_valid), F.lit(False))
    agree = F.coalesce(v & (r == t), F.lit(False))
    reason = F.when(agree, F.lit(None).cast("string")).when(t.isNull(), NO_TEMPLATE).when(~v, BAD_REREAD).otherwise(DISAGREES)
    return F.when(agree, "verified_reread").otherwise("flagged"), F.coalesce(r, t, m), reason


def digit_labels(df: DataFrame, keys: list[str], fret: str, boxes: str) -> DataFrame:
    """A row per digit where a number has as many digits as its note has boxes (STR-4)."""
    text = F.col(fret).cast("string")
    rows = df.where(F.col(fret).isNotNull() & (F.length(text) == F.col(boxes)))
    return rows.select(*keys, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "digit"))


def fret_of(text: str, most: int) -> Column:
    """The number a text spells without leading zeros, up to ``most``, else null (FLT-12)."""
    c = F.col(text)
    value = F.when(c.rlike("^(0|[1-9][0-9]*)$"), F.try_to_number(c, F.lit("999999999")).cast("int"))
    return F.when(value <= most, value)


def fret_text(fret: str) -> Column:
    return F.coalesce(F.col(fret).cast("string"), F.lit("?"))


def id_set_check(df: DataFrame, keys: list[str], expected: str, found: str) -> DataFrame:
    """Missing, extra and repeated ids and the first reason (JSN-4, SET-1, AGG-19)."""
    e, g = F.col(expected), F.col(found)
    out = df.withColumns({"missing": F.array_sort(F.array_except(e, g)), "extra": F.array_sort(F.array_except(g, e)),
                          "repeated": F.array_sort(F.array_distinct(F.filter(g, lambda x: F.size(F.filter(g, lambda y: y == x)) > 1)))})
    reason = F.when(F.size("repeated") > 0, "repeated").when(F.size("missing") > 0, "missing").when(F.size("extra") > 0, "extra")
    return out.select(*keys, *[F.array_join(c, ",").alias(c) for c in ("missing", "extra", "repeated")], reason.alias("reason"))


def json_check(df: DataFrame, text: str, most: int) -> DataFrame:
    """Strict check of {"notes": [{"id": int, "fret": int or null}]}: the first
    reason an answer is invalid, null if it is valid (JSN-1, JSN-3, JSN-6).
    Types come from the variant itself, so unknown and missing keys, booleans,
    texts and ranges are all seen."""
    v = F.try_parse_json(F.col(text))
    out = df.withColumn("_v", v).withColumn("_notes", F.try_variant_get("_v", "$.notes", "array<variant>"))
    out = out.withColumn("_keys", F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")))
    bad = F.exists("_notes", lambda n: ~F.coalesce(
        F.array_sort(F.map_keys(F.try_variant_get(n, "$", "map<string,variant>"))).eqNullSafe(F.array(F.lit("fret"), F.lit("id")))
        & F.schema_of_variant(F.try_variant_get(n, "$.id", "variant")).eqNullSafe("BIGINT") & (F.try_variant_get(n, "$.id", "bigint") >= 0)
        & (F.schema_of_variant(F.try_variant_get(n, "$.fret", "variant")).eqNullSafe("VOID")
           | (F.schema_of_variant(F.try_variant_get(n, "$.fret", "variant")).eqNullSafe("BIGINT") & F.try_variant_get(n, "$.fret", "bigint").between(0, most))), F.lit(False)))
    reason = F.when(F.col("_v").isNull(), "not JSON").when(~F.col("_keys").eqNullSafe(F.array(F.lit("notes"))) | F.col("_notes").isNull(), "schema").when(bad, "schema")
    return out.withColumn("reason", reason).drop("_v", "_notes", "_keys")


def by_id(df: DataFrame, keys: list[str], id_: str, value: str) -> DataFrame:
    """readings: a map from id to value for each key, ids in order (MAP-1)."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(id_).alias("k"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.map_from_entries(entries).alias("readings"))


def token_cost(calls: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Cost of each call; an unknown model is an error, not a null (PRJ-19, JOI-15)."""
    out = calls.join(prices, model, "left")
    price = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("no price for a model")).cast("double")).otherwise(F.col(c))
    cost = (F.coalesce("input_tokens", F.lit(0)) * price("input_price") + F.coalesce("output_tokens", F.lit(0)) * price("output_price")) / 1e6
    return out.withColumn("cost", cost)


def place_in_rows(notes: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Notes with the row that holds them (JOI-10, FLT-9): half-open, the last
    row closed. Rows do not overlap, so the last start at or before a note, by
    one sort of both, is the only row to test: no note meets all rows of its key."""
    own = [c for c in rows.columns if c not in keys]
    last = Window.partitionBy(*keys).orderBy(F.col("r").desc())
    starts = rows.withColumn("_last", F.row_number().over(last) == 1)
    starts = starts.select(*keys, F.col("x0").alias("_x"), F.lit(0).alias("_kind"), F.struct(*own, "_last").alias("_row"))
    both = notes.select(*keys, F.col("x").alias("_x"), F.lit(1).alias("_kind"), F.struct(*notes.columns).alias("_note")).unionByName(starts, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_row", F.last("_row", ignorenulls=True).over(by)).where("_kind = 1 AND _row IS NOT NULL")
    x, end = F.col("_note.x"), F.col("_row.x1")
    placed = placed.where((x < end) | (F.col("_row._last") & (x == end)))
    return placed.select(*keys, *[F.col(f"_note.{c}") for c in notes.columns if c not in keys], *[F.col(f"_row.{c}") for c in own])


RESPONSE = ("STRUCT<prompt_feedback: STRUCT<block_reason: STRING>, candidates: ARRAY<STRUCT<finish_reason: STRING, "
            "content: STRUCT<parts: ARRAY<STRUCT<text: STRING, thought: BOOLEAN>>>>>>")


def check_responses(df: DataFrame, response: str, ids: str, most: int) -> DataFrame:
    """``df`` plus reason, the first why a recorded answer is no reading of
    exactly ``ids`` (JSN-2, JSN-6, RED-1), and readings, its (id, fret), null if
    there is a reason. Parts of an answer that are thoughts are not text."""
    r = F.from_json(F.col(response), RESPONSE)
    found = F.coalesce(F.size(F.col("_r.candidates")), F.lit(0))
    one = F.get(F.col("_r.candidates"), F.lit(0))
    said = F.filter(F.col("_one.content.parts"), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    out = df.withColumn("_r", r).withColumn("_one", one)
    out = out.withColumn("_answer", F.coalesce(F.array_join(F.transform(said, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")))
    out = json_check(out, "_answer", most).withColumnRenamed("reason", "_bad")
    out = out.withColumn("_got", F.from_json("_answer", "notes ARRAY<STRUCT<id: BIGINT, fret: INT>>")["notes"])
    got = F.array_sort(F.col("_got.id"))
    blocked = F.coalesce(F.col("_r.prompt_feedback.block_reason"), F.lit(""))
    reason = (F.when(blocked != "", "blocked").when(F.greatest(found, F.lit(0)) != 1, "candidates")
              .when(~F.col("_one.finish_reason").eqNullSafe(F.lit("STOP")), "finish").when(F.col("_answer") == "", "no text")
              .when(F.col("_bad").isNotNull(), F.col("_bad")).when(~got.eqNullSafe(F.array_sort(F.col(ids).cast("array<bigint>"))), "ids"))
    out = out.withColumn("reason", reason).withColumn("readings", F.when(F.col("reason").isNull(), F.col("_got")))
    return out.drop("_r", "_one", "_answer", "_bad", "_got")


def scattered(checked: DataFrame, keys: list[str], ids: str) -> DataFrame:
    """A row per wanted id: its fret, and whether its answer was valid (RED-1).
    {null, valid} says 'not a number', {null, not valid} says nothing."""
    rows = checked.select(*keys, F.explode(ids).alias("id"), "readings")
    fret = F.get(F.filter("readings", lambda n: n["id"] == F.col("id")), F.lit(0))["fret"]
    return rows.select(*keys, "id", fret.alias("fret"), F.col("readings").isNotNull().alias("valid"))


def note_readings(digits: DataFrame, keys: list[str], pos: str, digit: str, most: int) -> DataFrame:
    """A note read digit by digit: its text, '?' where a digit was not read, and
    the fret that spells (RED-2, STR-5)."""
    each = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.coalesce(F.col(digit), F.lit("?")).alias("digit"))))
    return digits.groupBy(*keys).agg(F.array_join(each["digit"], "").alias("text")).withColumn("fret", fret_of("text", most))

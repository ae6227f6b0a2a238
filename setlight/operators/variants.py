"""Three-way merging of documents whose fields no schema lists, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,variant>"


def _text(value: Column) -> Column:
    """What two values are compared by: JSON with sorted keys. A missing value is null, a JSON null is not."""
    return F.to_json(value)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def merged_value(base: Column, mine: Column, theirs: Column, depth: int) -> Column:
    """My value where they left it alone, theirs where I did; objects field by field; other conflicts are mine.

    Objects more than ``depth`` levels down count as one value. Missing values are null.
    """
    whole = F.when(_text(mine).eqNullSafe(_text(base)), theirs).when(_text(theirs).eqNullSafe(_text(base)), mine)
    if depth == 0:
        return whole.otherwise(mine)
    objects = _is_object(mine) & _is_object(theirs) & (base.isNull() | _is_object(base))
    return whole.when(objects, merged_object(base, mine, theirs, depth - 1)).otherwise(mine)


def merged_object(base: Column, mine: Column, theirs: Column, depth: int) -> Column:
    """Objects field by field: what I deleted goes unless they changed it, what they deleted stays if I have it."""
    none = F.expr(f"cast(map() as {MAP})")
    b, m, t = (F.coalesce(F.when(_is_object(x), x).cast(MAP), none) for x in (base, mine, theirs))

    def field(k: Column) -> Column:
        own, old, new = m[k], b[k], t[k]
        deleted = F.when(~_text(new).eqNullSafe(_text(old)), new)
        value = F.when(own.isNull() & old.isNotNull(), deleted).when(own.isNull(), new).when(old.isNull() & new.isNull(), own).otherwise(merged_value(old, own, F.coalesce(new, old), depth))
        return F.struct(k.alias("key"), value.alias("value"))

    keys = F.array_union(F.array_union(F.map_keys(t), F.map_keys(m)), F.map_keys(b))
    fields = F.filter(F.transform(keys, field), lambda e: e["value"].isNotNull())
    return F.call_function("to_variant_object", F.map_from_entries(fields))


def three_way_documents(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str, doc: str, depth: int = 4) -> DataFrame:
    """(key, doc): JSON texts of three versions merged by key, with every field that any of them has.

    My documents stay, merged. One that I deleted stays only if they changed it; one that they deleted and I
    still have stays as mine. ``doc`` is VARIANT in the result; a text that is no JSON object counts as missing.
    """
    parsed = lambda df, p: df.select(key, F.try_parse_json(doc).alias(p)).where(_is_object(F.col(p)))
    full = parsed(base, "b").join(parsed(mine, "m"), key, "full_outer").join(parsed(theirs, "t"), key, "full_outer")
    b, m, t = F.col("b"), F.col("m"), F.col("t")
    keep = m.isNotNull() | (t.isNotNull() & ~_text(t).eqNullSafe(_text(b)))
    value = F.when(m.isNull(), t).when(b.isNull() & t.isNull(), m).otherwise(merged_value(b, m, F.coalesce(t, b), depth))
    return full.where(keep).select(key, value.alias(doc))


def known_fields(docs: DataFrame, doc: str, fields: dict[str, str]) -> DataFrame:
    """``docs`` with columns for the fields that a schema knows (name -> type); a value of another type is null."""
    return docs.withColumns({name: F.try_variant_get(doc, f"$.{name}", kind) for name, kind in fields.items()})

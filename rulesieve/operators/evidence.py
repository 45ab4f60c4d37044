"""Shaping raw tables into the long evidence table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulesieve import schema
from rulesieve.functions.literals import escape_char


def code_containers(entries: DataFrame, prefix: str = "classes", suffix: str = ".dex") -> DataFrame:
    """Entries that hold code: name starts and ends as given."""
    name = F.col("name")
    return entries.where(F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix)))


def native_lib_names(entries: DataFrame, root: str = "lib", suffix: str = ".so") -> DataFrame:
    """Split ``lib/<abi>/<file>.so``; names with any other depth are dropped."""
    name = F.col("name")
    parts = F.split(name, "/")
    return (
        entries.where(F.startswith(name, F.lit(f"{root}/")) & F.endswith(name, F.lit(suffix)))
        .where(F.size(parts) == 3)
        .withColumn("abi", F.element_at(parts, 2))
        .withColumn("filename", F.element_at(parts, 3))
    )


def element_text(tag: str = "tag", attrs: str = "attrs") -> Column:
    """``tag k=v k=v `` with a blank after every part, duplicates kept."""
    pairs = F.transform(attrs, lambda a: F.concat(a["k"], F.lit("="), a["v"], F.lit(" ")))
    return F.concat(F.col(tag), F.lit(" "), F.array_join(pairs, ""))


def manifest_haystack(elements: DataFrame, segment: int | None = None, lookahead: int | None = None) -> DataFrame:
    """One searchable string per artifact, in document order.

    By default an artifact is one row, whatever its size: a string that rules
    search is one value. Only for a search of literals in huge artifacts,
    ``segment`` cuts it into rows of so many element positions, and
    ``lookahead``, which must then be named, appends that many characters of the
    following ones: with the longest literal's length minus one, every literal
    is found in some row if it is found in the undivided string; one that begins
    in a lookahead is found in two rows. Rows without an artifact id are left
    out; null positions come first.
    """
    if segment is None:
        lookahead = 0
    elif lookahead is None:
        raise ValueError("segments need a lookahead: the longest literal's length minus one")
    # The null test is what the join below implies for one of its sides; stated
    # for both, the two sides share one shuffle.
    parts = elements.where(F.col("artifact_id").isNotNull()).select(
        "artifact_id",
        (F.lit(0) if segment is None else F.coalesce(F.floor(F.col("elem_ord") / segment), F.lit(-1)))
        .cast("long")
        .alias("segment"),
        F.struct("elem_ord", element_text().alias("text")).alias("part"),
    )
    texts = (
        parts.groupBy("artifact_id", "segment")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select("artifact_id", "segment", F.array_join(F.col("parts.text"), "").alias("haystack"))
    )
    if lookahead <= 0:
        return texts
    # Each segment has at least one character, so this many rows suffice. Only
    # the heads pass through the per-artifact window, never the texts.
    following = Window.partitionBy("artifact_id").orderBy("segment").rowsBetween(1, lookahead)
    head = F.left("haystack", F.lit(lookahead))
    tails = (
        texts.select("artifact_id", "segment", head.alias("head"))
        .withColumn("tail", F.left(F.array_join(F.collect_list("head").over(following), ""), F.lit(lookahead)))
        .where(F.col("tail") != "")
        .drop("head")
    )
    return texts.join(tails, ["artifact_id", "segment"], "left").select(
        "artifact_id", "segment", F.concat("haystack", F.coalesce("tail", F.lit(""))).alias("haystack")
    )


def manifest_evidence(elements: DataFrame, segment: int | None = None, lookahead: int | None = None) -> DataFrame:
    """Manifest haystacks as evidence rows (see :func:`manifest_haystack`)."""
    hay = manifest_haystack(elements, segment, lookahead)
    return evidence(
        hay, "manifest", F.col("artifact_id"), F.lit("manifest"), F.col("segment"), F.lit(0), F.col("haystack")
    )


def _attr(key: str) -> Column:
    return F.get(F.filter("attrs", lambda a: a["k"] == key), F.lit(0))["v"]


def first_attr(elements: DataFrame, key: str, tag: str | None = None) -> DataFrame:
    """Value of ``key`` in the first element (of ``tag``) of each artifact.

    The first value wins where an element repeats the key. Null when that
    element lacks the key, even if a later element has it.
    """
    position = F.col("elem_ord") if tag is None else F.when(F.col("tag") == tag, F.col("elem_ord"))
    return elements.groupBy("artifact_id").agg(F.min_by(_attr(key), position).alias("value"))


def attr_values(elements: DataFrame, tag: str, key: str) -> DataFrame:
    """All values of ``key`` over the elements with ``tag``, in element order."""
    return (
        elements.where(F.col("tag") == tag)
        .select("artifact_id", "elem_ord", _attr(key).alias("value"))
        .where(F.col("value").isNotNull())
    )


def explode_strings(df: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """One row per string of a container, with its position (from 0)."""
    others = [c for c in df.columns if c != text]
    pattern = "".join(escape_char(c) for c in separator)
    return df.select(*others, F.posexplode(F.split(F.col(text), pattern)).alias("ordinal", "value"))


def evidence(
    df: DataFrame,
    kind: str,
    artifact_id: Column,
    container: Column,
    container_ord: Column,
    ordinal: Column,
    value: Column,
) -> DataFrame:
    """Project any table onto the evidence schema."""
    return df.select(
        artifact_id.cast("string").alias("artifact_id"),
        F.lit(kind).alias("kind"),
        container.cast("string").alias("container"),
        container_ord.cast("long").alias("container_ord"),
        ordinal.cast("int").alias("ordinal"),
        value.alias("value"),
    )


def lib_evidence(libs: DataFrame) -> DataFrame:
    """Evidence rows for the libraries :func:`native_lib_names` found."""
    return evidence(
        libs,
        "native_lib_name",
        F.col("artifact_id"),
        F.col("abi"),
        F.col("entry_ord"),
        F.lit(0),
        F.col("filename"),
    )


def entry_evidence(entries: DataFrame) -> DataFrame:
    """Evidence rows for all entry names."""
    name = F.col("name")
    return evidence(entries, "zip_entry", F.col("artifact_id"), name, F.col("entry_ord"), F.lit(0), name)


def build_evidence(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of evidence tables of different kinds."""
    out = parts[0].select(*schema.EVIDENCE.names)
    for part in parts[1:]:
        out = out.unionByName(part.select(*schema.EVIDENCE.names))
    return out


def search(df: DataFrame, columns: Sequence[str], query: str, label: str, source: str) -> DataFrame:
    """Rows whose ``columns`` contain ``query``, any letter case, by label.

    A blank query keeps all rows; rows without a source are dropped. Equal labels
    are ordered further, so that a label many rows share can still be split.
    """
    kept = df.where(F.col(source).isNotNull() & (F.col(source).cast("string") != ""))
    if query.strip():
        needle = F.lit(query.lower())
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), needle), F.lit(False))
        kept = kept.where(hit)
    return kept.orderBy(F.lower(F.col(label)), label, *columns, source)

"""File readers and sinks, and parsers of scraped payloads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.numeric import clean_number, month_number

# Accepted headers of each canonical column (upper case, trimmed).
BAR_HEADERS = {
    "symbol": ("SYMBOL", "TCKRSYMB"),
    "series": ("SERIES", "SCTYSRS"),
    "op": ("OPEN", "OPNPRIC"),
    "hi": ("HIGH", "HGHPRIC"),
    "lo": ("LOW", "LWPRIC"),
    "cl": ("CLOSE", "CLSPRIC"),
    "vol": ("TOTTRDQTY", "TTL_TRD_QNTY", "TOTAL_TRADED_QTY", "TTLTRADGVOL"),
}
SYMBOL_HEADERS = ("SYMBOL", "TICKER")
SECTOR_HEADERS = ("INDUSTRY", "SECTOR")


def rename_headers(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Canonical names for the first matching header of each alias list (or the name itself); others are dropped."""
    found = {c.strip().upper(): c for c in df.columns}
    picks = {name: next((found[h] for h in (*heads, name.upper()) if h in found), None) for name, heads in aliases.items()}
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in picks.items() if c is not None])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False)


def read_universe(spark: SparkSession, path: str, suffix: str = "", index_names: Sequence[str] = ()) -> DataFrame:
    """Distinct trimmed symbols without index rows, with an exchange suffix."""
    raw = rename_headers(read_csv(spark, path), {"symbol": SYMBOL_HEADERS})
    sym = raw.select(F.trim("symbol").alias("tk")).where("tk is not null and tk <> ''")
    if index_names:
        sym = sym.where(~F.col("tk").isin(*index_names))
    return sym.select(F.concat("tk", F.lit(suffix)).alias("tk")).distinct()


def read_sector_map(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    raw = rename_headers(read_csv(spark, path), {"symbol": SYMBOL_HEADERS, "sector": SECTOR_HEADERS})
    return raw.select(F.concat(F.trim("symbol"), F.lit(suffix)).alias("tk"), F.trim("sector").alias("sector")).dropDuplicates(["tk"])


def with_sector(df: DataFrame, sectors: DataFrame, default: str = "Others") -> DataFrame:
    return df.join(sectors, "tk", "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def eligible_flag(df: DataFrame, eligible: DataFrame) -> DataFrame:
    """1 for members of the list, else 0."""
    mark = eligible.select("tk", F.lit(1).alias("_e")).distinct()
    return df.join(mark, "tk", "left").withColumn("eligible", F.coalesce("_e", F.lit(0))).drop("_e")


def unify_bar_layouts(frames: Sequence[DataFrame], series: str = "EQ", extra: Sequence[str] = ("d",)) -> DataFrame:
    """Bar files of several header layouts as one typed frame, one series only."""
    out = None
    for df in frames:
        keep = {c: (c.upper(),) for c in extra}
        part = rename_headers(df, {**BAR_HEADERS, **keep}).where(F.trim("series") == series)
        part = part.withColumns({c: F.lit(None).cast("string") for c in ("op", "hi", "lo", "cl", "vol") if c not in part.columns})
        part = part.select(
            F.trim("symbol").alias("tk"),
            *[F.col(c).try_cast("date").alias(c) for c in extra],
            *[F.col(c).cast("string").try_cast("double").alias(c) for c in ("op", "hi", "lo", "cl")],
            F.col("vol").cast("string").try_cast("double").cast("bigint").alias("vol"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_zipped_bars(spark: SparkSession, path: str) -> DataFrame:
    """Zipped daily bar files; each archive is one day and is unpacked inside a task."""
    names = list(BAR_HEADERS)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as z:
                    for member in z.namelist():
                        raw = pd.read_csv(z.open(member), dtype=str)
                        raw.columns = [c.strip().upper() for c in raw.columns]
                        pick = {n: next((raw[h] for h in heads if h in raw), None) for n, heads in BAR_HEADERS.items()}
                        yield pd.DataFrame({**pick, "path": path_}, index=raw.index)[[*names, "path"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, ", ".join(f"{n} string" for n in [*names, "path"]))


def export_tiers(panel: DataFrame, root: str, stamp: str, tiers: Sequence[str] | None = None) -> str:
    """Snappy Parquet under a dated folder, optionally only some tiers; returns the root."""
    rows = panel if tiers is None else panel.where(F.col("tier").isin(*tiers))
    rows.write.mode("overwrite").option("compression", "snappy").parquet(f"{root}/stamp={stamp}")
    return root


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest dated folder; the filter prunes the others."""
    all_runs = spark.read.parquet(root)
    newest = all_runs.agg(F.max("stamp")).scalar()
    return all_runs.where(F.col("stamp") == newest).drop("stamp")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


PAYLOAD = "array<struct<DateText:string,NetValue:double>>"


def parse_monthly(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``[{"DateText": "Mar 2026", "NetValue": 1.5}]`` to (y, m, net); items without a value are skipped."""
    item = df.select(F.explode(F.from_json(payload, PAYLOAD)).alias("i")).where("i.NetValue is not null")
    part = F.split(F.trim("i.DateText"), r"\s+")
    return item.select(part[1].cast("int").alias("y"), month_number(part[0]).alias("m"), F.col("i.NetValue").alias("net"))


def parse_daily(df: DataFrame, key: str, asof: Column, payload: str = "payload") -> DataFrame:
    """``Apr 16`` items, newest first and without a year: the year drops whenever the month jumps up.

    ``asof`` is the date of the download. One payload is one feed's day list, bounded by the calendar.
    """

    item = df.select(key, asof.alias("_asof"), F.posexplode(F.from_json(payload, PAYLOAD)).alias("pos", "i"))
    item = item.where("i.NetValue is not null")
    part = F.split(F.trim("i.DateText"), r"\s+")
    item = item.select(
        key, "_asof", "pos", month_number(part[0]).alias("_m"), part[1].cast("int").alias("_day"), F.col("i.NetValue").alias("net")
    )
    w = Window.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.lag("_m").over(w), F.month("_asof"))
    item = item.withColumn("_jump", (F.col("_m") > before).cast("int"))
    back = F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return item.withColumn("_y", F.year("_asof") - back).select(
        key, F.make_date("_y", "_m", "_day").alias("d"), "net"
    )


class _Tables(HTMLParser):
    """Cells of the tables inside ``<section id=...>`` elements."""

    def __init__(self) -> None:
        super().__init__()
        self.section, self.row, self.cell, self.rows = None, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "section":
            self.section = dict(attrs).get("id")
        elif tag == "tr" and self.section:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data.strip())

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append("".join(self.cell))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append((self.section, self.row))
            self.row = None
        elif tag == "section":
            self.section = None


def statement_cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """Statement tables of each page as (key, section, row_name, label, text); pages are split over tasks."""
    schema = T.StructType(
        [df.schema[key]] + [T.StructField(c, T.StringType()) for c in ("section", "row_name", "label", "text")]
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html]):
                page = _Tables()
                page.feed(text or "")
                heads: dict[str, list[str]] = {}
                for section, cells in page.rows:
                    if section not in heads:
                        heads[section] = cells[1:]
                        continue
                    name = cells[0].rstrip("+").strip()
                    out += [(k, section, name, h, v) for h, v in zip(heads[section], cells[1:]) if name]
            yield pd.DataFrame(out, columns=[key, "section", "row_name", "label", "text"])

    return df.select(key, html).mapInPandas(parse, schema)


def statement_values(cells: DataFrame) -> DataFrame:
    return cells.withColumn("value", clean_number("text")).where("value is not null").drop("text")


def pick_row(values: DataFrame, keys: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Value of the row matching one of the words: an exact name first, else one containing a word."""
    name = F.lower("row_name")
    exact = name.isin(*[w.lower() for w in words])
    partial = F.lit(False)
    for w in words:
        partial = partial | name.contains(w.lower())
    hit = values.withColumn("_p", F.when(exact, 0).when(partial, 1)).where("_p is not null")
    return hit.groupBy(*keys).agg(F.min_by("value", F.struct("_p", "row_name")).alias("value"))


def list_items(df: DataFrame, key: str, html: str) -> DataFrame:
    """Name and value of ``<li>`` entries: the first two inline texts of ratio boxes, or link target and text."""
    item = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("pos", "li"))
    spans = F.regexp_extract_all("li", F.lit(r"(?s)<span[^>]*>(.*?)</span>"), F.lit(1))
    link = F.regexp_extract("li", r'href="([^"]*)"', 1)
    plain = F.trim(F.regexp_replace("li", r"<[^>]*>", ""))
    two = F.size(spans) >= 2
    return item.select(
        key, "pos",
        F.when(two, F.trim(F.get(spans, F.lit(0)))).otherwise(plain).alias("name"),
        F.when(two, F.trim(F.get(spans, F.lit(1)))).otherwise(link).alias("value"),
    )



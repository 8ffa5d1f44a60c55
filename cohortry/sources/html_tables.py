"""Tables inside landed HTML pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.functions import scalar as fn

# The table's class, the marker of repeated header rows and the columns.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "amp": "&"}
TABLE_CLASS = "data"
HEADER_PREFIX = "Round"
MEASURE_COLUMNS = [
    "round", "pick", "ov", "team", "name", "pos", "country", "height", "weight", "league_name", "junior_team",
]


def decode_entities(text: Column) -> Column:
    """Decimal, hexadecimal and the common named references as characters; the ampersand last."""

    def numbered(text: Column, pattern: str, prefix: str, base: int) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))

        def put(done: Column, digits: Column) -> Column:
            code = F.lpad(F.hex(F.conv(digits, base, 10).cast("bigint")), 8, "0")
            shown = F.decode(F.unhex(code), "UTF-32")
            return F.replace(done, F.concat(F.lit(prefix), digits, F.lit(";")), shown)

        return F.aggregate(found, text, put)

    text = numbered(numbered(text, r"&#(\d{1,6});", "&#", 10), r"&#x([0-9a-fA-F]{1,5});", "&#x", 16)
    for name, shown in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(shown))
    return text


def table_cells(pages: DataFrame, html: str = "html", table_class: str = TABLE_CLASS, header: str = HEADER_PREFIX) -> DataFrame:
    """Body rows of each page's first table of the class, as an array of stripped cells.

    Rows without cells and repeated header rows are left out.
    """
    token = rf"""class\s*=\s*(?:"(?:[^"]*\s)?{table_class}(?:\s[^"]*)?"|'(?:[^']*\s)?{table_class}(?:\s[^']*)?')"""
    body = F.regexp_extract(html, rf"(?si)<table\s[^>]*{token}[^>]*>.*?<tbody[^>]*>(.*?)</tbody>", 1)
    rows = pages.withColumn("_body", body).withColumn(
        "_row", F.explode(F.regexp_extract_all("_body", F.lit("(?si)<tr[^>]*>(.*?)</tr>"), 1))
    )
    found = F.regexp_extract_all("_row", F.lit("(?si)<td[^>]*>(.*?)</td>"), 1)
    text = F.transform(found, lambda c: fn.strip(decode_entities(F.regexp_replace(c, "<[^>]*>", ""))))
    cells = rows.withColumn("cells", text).drop("_body", "_row", html)
    return cells.where((F.size("cells") > 0) & ~F.get("cells", F.lit(0)).startswith(header))


def measure_rows(pages: DataFrame) -> DataFrame:
    """Draft measurements in metric units from ``year, html`` pages."""
    cells = table_cells(pages)
    named = cells.select("year", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(MEASURE_COLUMNS)])
    return named.withColumns(
        {"ov": F.col("ov").try_cast("int"), "height": fn.height_cm("height"), "weight": fn.weight_kg("weight")}
    ).select(*MEASURE_COLUMNS, "year")


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """Tables landed by year, in one read; the year comes from the folder's name."""
    return spark.read.parquet(path)


def union_years(frames: dict[int, DataFrame]) -> DataFrame:
    """Per-year frames under each other, tagged with their year."""
    tagged = [df.withColumn("year", F.lit(year)) for year, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

"""Display helpers of the reference's table views (F26-F28), as column
expressions so formatting runs on the executors with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from storepulse.functions.columns import truncate_text


def title_label(name: str) -> str:
    """'total_sales' -> 'Total Sales' (column headers)."""
    return name.replace("_", " ").title()


def table_view(df: DataFrame, max_chars: int = 50) -> DataFrame:
    """F27 + F28: text cells longer than ``max_chars`` cut to that many
    characters plus '...', columns renamed to title-case labels.  Only
    string columns are cut (numbers keep their type; the reference's
    str() of a number is engine-specific text)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            c = truncate_text(c, max_chars)
        cols.append(c.alias(title_label(f.name)))
    return df.select(*cols)


def comparison_display(cmp: DataFrame) -> DataFrame:
    """the promotional comparison table as text -- money columns as
    '$1,234.56', counts as whole numbers, and every cell of the
    'Change (%)' row as '12.34%'."""
    change = F.col("period_type") == "Change (%)"

    def pct(c):
        return F.concat(F.format_string("%.2f", F.col(c)), F.lit("%"))

    money = {c: F.when(change, pct(c)).otherwise(F.concat(F.lit("$"), F.format_number(F.col(c), 2)))
             for c in ("total_sales", "avg_transaction_value")}
    count = {c: F.when(change, pct(c)).otherwise(F.col(c).cast("bigint").cast("string"))
             for c in ("transaction_count", "items_sold")}
    return cmp.select("period_type", *[(money | count)[c].alias(c) for c in
                                      ("total_sales", "transaction_count", "avg_transaction_value", "items_sold")])

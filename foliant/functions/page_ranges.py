"""Page ranges as a table function: ``SELECT * FROM page_ranges(TABLE(wanted))``, where ``wanted`` has doc_id, ranges and n_pages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from foliant.operators.lines import page_numbers


class PageRanges:
    """(doc_id, page, error): each chosen page once, ascending; what can't be chosen is one row that says why. Null ranges choose nothing."""

    def eval(self, row):
        if row["ranges"] is None:
            return
        try:
            for page in page_numbers(row["ranges"], row["n_pages"] or 0):
                yield row["doc_id"], page, None
        except ValueError as wrong:
            yield row["doc_id"], None, str(wrong)


def register(spark: SparkSession, name: str = "page_ranges") -> None:
    spark.udtf.register(name, udtf(PageRanges, returnType="doc_id bigint, page int, error string"))

"""Tables in web pages: the largest table of a page as rows of cells."""

from html.parser import HTMLParser

from pyspark.sql import functions as F, types as T

from kinetable.functions.text import hex_number, last_component


class TableReader(HTMLParser):
    """Collect every table's direct children and rows; cells keep all their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []  # names of open elements; tables, rows and cells with their record
        self.tables = []

    def records(self, name):
        return [record for tag, record in self.open if tag == name]

    def count_child(self):
        if self.open and self.open[-1][0] == "table":
            self.open[-1][1]["children"] += 1

    def close(self, names, until):
        """Close open elements of the given names up to the nearest ``until``."""
        for spot in range(len(self.open) - 1, -1, -1):
            tag = self.open[spot][0]
            if tag in names:
                del self.open[spot:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("td", "th"):
            self.close(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self.close(("tr",), ("table",))
        elif tag not in ("table", "tbody", "thead", "tfoot"):
            self.count_child()
            return
        self.count_child()
        record = {"children": 0, "rows": [], "cells": [], "text": []}
        if tag == "table":
            self.tables.append(record)
        elif tag == "tr":
            for table in self.records("table"):
                table["rows"].append(record)
        elif tag == "td":
            for row in self.records("tr"):
                row["cells"].append(record)
        self.open.append((tag, record))

    def handle_endtag(self, tag):
        if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th"):
            self.close((tag,), () if tag == "table" else ("table",))

    def handle_data(self, data):
        self.count_child()
        for cell in self.records("td"):
            cell["text"].append(data)


def largest_table(html):
    """Rows of the page's largest table: trimmed cells, empty ones left out."""
    if html is None:
        return None
    reader = TableReader()
    reader.feed(html)
    if not reader.tables:
        return []
    biggest = max(reader.tables, key=lambda t: t["children"])
    rows = [["".join(c["text"]).strip() for c in row["cells"]] for row in biggest["rows"]]
    rows = [[cell for cell in row if cell] for row in rows]
    return [row for row in rows if row]


@F.udtf(returnType=T.StructType([T.StructField("n", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
class LargestTable:
    """Table function: the rows of a page's largest table, numbered from 0."""

    def eval(self, html: str):
        for n, row in enumerate(largest_table(html) or ()):
            yield n, row


def largest_table_rows(pages, html="html", keys=("page_id",)):
    """One row per row of each page's largest table, in page order.

    Pages without a table are left out by a built-in filter and reach no
    parser; the rows of the others come one by one from a table function, so no
    page's table is built up as one value.  Null pages have no rows.
    """
    named = pages.where(F.col(html).ilike("%<table%")).select(*keys, F.col(html).alias("_html"))
    return named.lateralJoin(LargestTable(F.col("_html").outer())).select(*keys, "n", "cells")


# ---------------------------------------------------------------- fixed values
NAMED_COLUMNS = (("Name", None), ("Type", None), ("Number", "hex"), ("Level", None))
TABLE_COLUMNS = {
    "service_UUIDs": NAMED_COLUMNS,
    "descriptor_UUIDs": NAMED_COLUMNS,
    "characteristic_UUIDs": NAMED_COLUMNS,
    "units_UUIDs": (("Number", "hex"), ("Name", None), ("Type", None)),
    "formats": (("Name", None), ("Description", None)),
}
# ------------------------------------------------------------ end fixed values

#: Converters by name; more can be added.
CONVERTERS = {None: lambda c: c, "hex": hex_number, "int": lambda c: c.try_cast("long")}


def typed_rows(rows, columns, cells="cells"):
    """Typed columns of table rows by a list of (name, converter).

    A row with another number of cells, or a cell its converter cannot read,
    is kept with a text in ``error`` instead of stopping the job.
    """
    values, failures = {}, []
    fits = F.size(cells) == len(columns)
    for i, (name, converter) in enumerate(columns):
        convert = CONVERTERS[converter] if converter is None or isinstance(converter, str) else converter
        cell = F.get(cells, F.lit(i))
        values[name] = F.when(fits, convert(cell))
        failures.append(F.when(fits & cell.isNotNull() & convert(cell).isNull(), F.lit(f"cannot read {name}")))
    arity = F.when(~fits, F.concat(F.lit(f"expected {len(columns)} cells, got "), F.size(cells).cast("string")))
    return rows.withColumns({**values, "error": F.coalesce(arity, *failures)})


def catalogue(rows, kind):
    """Assigned numbers of one kind: kind, number, short name, name, description."""
    typed = typed_rows(rows, TABLE_COLUMNS[kind]).where(F.col("error").isNull())
    short = last_component(F.col("Type")) if kind != "formats" else F.col("Name")
    number = F.col("Number") if kind != "formats" else F.lit(None).cast("long")
    text = F.col("Description") if kind == "formats" else F.lit(None).cast("string")
    return typed.select(
        F.lit(kind).alias("kind"), number.alias("number"), short.alias("cname"),
        F.col("Name").alias("name"), text.alias("description"),
    )


def catalogues(rows_by_kind):
    """All kinds in one table."""
    parts = [catalogue(rows, kind) for kind, rows in rows_by_kind.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def to_catalog(table):
    """One JSON text per kind with its sorted entries.

    The assigned numbers of a kind are a fixed public list of a few hundred.
    """
    entry = F.when(F.col("kind") == "formats", F.array("name", "description")).otherwise(
        F.array(F.col("number").cast("string"), "cname", "name")
    )
    grouped = table.groupBy("kind").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    return grouped.select("kind", F.to_json("_entries").alias("entries"))


def write_catalog(table, path, mode="errorifexists"):
    to_catalog(table).write.mode(mode).json(path)

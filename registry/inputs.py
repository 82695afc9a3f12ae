"""Readers, writers, message formats and page tables."""

from pyspark.sql import functions as F

from kinetable.functions.decoders import decode
from kinetable.operators import align
from kinetable.plans import tables
from kinetable.schema import axis_columns
from kinetable.session import scratch_path
from kinetable.sources import files, messages as msg, pages
from registry.common import AXIS, IMU, LONG, query, rounded


def read_back(spark, folder, layout):
    """The recordings written as headerless CSV and read as samples, with their session behind the label.

    Spark names the files of a write itself, so a file's name says nothing of the recording here.
    """
    path = scratch_path(spark, "samples")
    rows = tables.imu(spark, folder)
    columns = [f"{a}{s}" for s in layout for a in "xyz"]
    rows.select("seq", *columns, "label", "session_id").write.csv(path)
    schema = files.sample_schema(layout).add("session", "long")
    back = files.read_samples(spark, path, layout, schema)
    return back.withColumn("session_id", F.col("session")).drop("session").withColumns({"label": F.col("label").cast("long")})


for layout in files.LAYOUTS:
    names = axis_columns(layout)

    @query(
        f"csv_samples_{layout}",
        f"""with {IMU} select session_id, seq as index, {', '.join(f'"{c}"' for c in names)}, cast(label as bigint) as label
        from imu""",
    )
    def csv_samples(spark, folder, layout=layout):
        return read_back(spark, folder, layout)


@query(
    "phone_samples",
    f"""with {IMU} select seq as index, "xL" as x, "yL" as y, "zL" as z, cast(label as varchar) as label from imu""",
)
def phone_samples(spark, folder):
    path = scratch_path(spark, "phone")
    rows = tables.imu(spark, folder)
    rows.select(
        "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), F.lit(0).alias("b"), "xL", "yL", "zL",
        F.lit("a").alias("user"), F.lit("nexus4").alias("model"), F.lit("nexus4_1").alias("device"),
        F.col("label").cast("string").alias("label"),
    ).write.csv(path)
    return files.read_phone_samples(spark, path).drop("session_id")


@query(
    "aligned_csv",
    f"""with {IMU}, {LONG}
    select l.seq, {', '.join(f'{s.lower()}.{a} as "{a}{s}"' for s in 'LRC' for a in 'xyz')}, cast(c.label as bigint) as label
    from imu_long l join imu_long r on l.session_id = r.session_id and l.seq = r.seq
      join imu_long c on l.session_id = c.session_id and l.seq = c.seq
    where l.sensor = 'L' and r.sensor = 'R' and c.sensor = 'C'""",
)
def aligned_csv(spark, folder):
    aligned = align.align_sensors(tables.imu_long(spark, folder))
    path = scratch_path(spark, "aligned")
    files.write_samples(aligned.withColumn("person", F.col("session_id") % 7), path)
    schema = files.sample_schema("LRC")
    back = spark.read.schema(schema).csv(f"{path}/*/*")
    return back.withColumnRenamed("index", "seq").withColumn("label", F.col("label").cast("long"))


@query(
    "single_topic_batches",
    f"""with {IMU} select session_id, seq // 20 as batch, seq % 20 + 1 as index, seq % 20 as pos,
      round("xL", 12) as x, round("yL", 12) as y, round("zL", 12) as z from imu""",
)
def single_topic_batches(spark, folder):
    rows = tables.imu(spark, folder).select(
        "session_id", F.floor(F.col("seq") / 20).alias("batch"),
        F.struct((F.col("seq") % 20 + 1).alias("index"), F.col("xL").alias("x"), F.col("yL").alias("y"), F.col("zL").alias("z")).alias("r"),
    )
    texts = rows.groupBy("session_id", "batch").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("payload"))
    return rounded(msg.placed_batches(texts, keys=("session_id", "batch"), layout="L"), 12)


@query(
    "pair_batches_json",
    f"""with {IMU} select session_id, seq // 26 as batch, seq, {', '.join(f'round("{c}", 2) as "{c}"' for c in AXIS[:6])} from imu""",
)
def pair_batches_json(spark, folder):
    rows = tables.imu(spark, folder)
    sides = [F.struct(*[F.col(f"{a}{s}").alias(a) for a in "xyz"]) for s in "LR"]
    item = F.struct("seq", msg.pair_payload(*sides).alias("t"))
    texts = rows.groupBy("session_id", F.floor(F.col("seq") / 26).alias("batch")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    texts = texts.withColumn(
        "payload", F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["t"]), ","), F.lit("]"))
    )
    back = msg.placed_batches(texts, keys=("session_id", "batch"), layout="LR")
    return rounded(back.withColumn("seq", F.col("batch") * 26 + F.col("pos")).drop("pos"), 9)


@query(
    "response_log",
    """select event_id, printf('%012x', user_id) as raw_addr,
      concat_ws(':', '00', '00', '00', '00', printf('%02x', user_id >> 8), printf('%02x', user_id & 255)) as addr,
      user_id % 2 + 1 as addr_type, cast(floor(value) as bigint) as rssi, 0 as flag, lower(hex(event_type)) as data
    from events where event_id % 3 <> 2""",
)
def response_log(spark, folder):
    """Helper log lines made of the events, with comments between them."""
    events = tables.table(spark, folder, "events")
    line = F.concat_ws(
        "\x1e",
        F.lit("rsp=$scan"),
        F.concat(F.lit("addr=b"), F.lower(F.lpad(F.hex("user_id"), 12, "0"))),
        F.concat(F.lit("type=h"), F.hex(F.col("user_id") % 2 + 1)),
        F.concat(F.lit("rssi=h"), F.hex(F.floor("value"))),
        F.lit("flag=h0"),
        F.concat(F.lit("d=b"), F.hex(F.col("event_type").cast("binary"))),
    )
    lines = events.select("event_id", F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    found = msg.adverts_of_log(msg.parse_response_log(lines))
    return found.select(
        "event_id", F.lower(F.replace("addr", F.lit(":"), F.lit(""))).alias("raw_addr"), "addr", "addr_type", "rssi",
        F.col("flag").cast("int").alias("flag"), F.lower(F.hex("data")).alias("data"),
    )


@query(
    "payload_table",
    "select user_id || '' as device, count(*) as n, cast(sum(cast(floor(value) as bigint) % 100) as bigint) as total from events group by user_id",
)
def payload_table(spark, folder):
    """Payloads written and read as a table, then decoded."""
    events = tables.table(spark, folder, "events")
    path = scratch_path(spark, "payloads")
    events.select(
        F.col("user_id").cast("string").alias("device"), F.lit("CC2650").alias("generation"),
        F.lit("2a19").alias("characteristic"), "ts",
        F.unhex(F.lpad(F.hex(F.floor("value") % 100), 2, "0")).alias("data"),
    ).write.parquet(path)
    read = decode(files.read_payloads(spark, path), "battery")
    return read.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.sum("percent").cast("long").alias("total"))


# A page with a small table, its own text, and the large table in between.
def pages_with_tables(spark, folder):
    source = tables.table(spark, folder, "pages")
    key = F.col("page_id")

    def row(*cells):
        return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td> "), c, F.lit(" </td>"))], F.lit("</tr>"))

    def text(value):
        return F.lit(value)

    number = F.concat(F.lit("0x"), F.hex(key + 6144))
    big = F.concat(
        F.lit("<table><tr><th>Name</th><th>Number</th></tr>"),
        row(F.concat(F.lit("Page &amp; "), key.cast("string")), F.concat(F.lit("org.pages.page_"), key.cast("string")), number, text("Adopted")),
        row(F.concat(F.lit("Link <a href='x'>"), key.cast("string"), F.lit("</a>")), F.concat(F.lit("org.pages.link_"), key.cast("string")),
            F.concat(F.lit("0x"), F.hex(key * 3)), text("Draft")),
        row(text("Broken"), text("org.pages.broken"), text("0xZZ"), text("Draft")),
        row(text("Short"), text("")),
        F.lit("</table>"),
    )
    small = F.lit("<table><tr><td>small</td></tr></table>")
    return source.select("page_id", F.concat(small, "html", big).alias("html"))


@query(
    "page_table_rows",
    """select page_id, cast(n as bigint) as n, cast(size as bigint) as size, first from (
      select page_id, 0 as n, 4 as size, 'Page & ' || page_id as first from pages union all
      select page_id, 1, 4, 'Link ' || page_id from pages union all
      select page_id, 2, 4, 'Broken' from pages union all
      select page_id, 3, 1, 'Short' from pages) t""",
)
def page_table_rows(spark, folder):
    rows = pages.largest_table_rows(pages_with_tables(spark, folder))
    return rows.select(
        "page_id", F.col("n").cast("long").alias("n"), F.size("cells").cast("long").alias("size"),
        F.get("cells", F.lit(0)).alias("first"),
    )


@query(
    "page_typed_rows",
    """select page_id, 'Page & ' || page_id as name, page_id + 6144 as number, cast(null as varchar) as error from pages union all
    select page_id, 'Link ' || page_id, page_id * 3, null from pages union all
    select page_id, 'Broken', null, 'cannot read Number' from pages union all
    select page_id, null, null, 'expected 4 cells, got 1' from pages""",
)
def page_typed_rows(spark, folder):
    rows = pages.largest_table_rows(pages_with_tables(spark, folder))
    typed = pages.typed_rows(rows, pages.TABLE_COLUMNS["service_UUIDs"])
    return typed.select("page_id", F.col("Name").alias("name"), F.col("Number").alias("number"), "error")


@query(
    "page_catalogue",
    """select kind, number, cname, name from (
      select 'service_UUIDs' as kind, page_id + 6144 as number, 'page_' || page_id as cname, 'Page & ' || page_id as name from pages union all
      select 'service_UUIDs', page_id * 3, 'link_' || page_id, 'Link ' || page_id from pages union all
      select 'formats', null, 'format' || page_id, 'format' || page_id from pages) t""",
)
def page_catalogue(spark, folder):
    services = pages.largest_table_rows(pages_with_tables(spark, folder))
    source = tables.table(spark, folder, "pages")
    name = F.concat(F.lit("format"), F.col("page_id").cast("string"))
    made = source.select(
        "page_id",
        F.concat("html", F.lit("<table><tr><td>"), name, F.lit("</td><td>of "), "url", F.lit("</td></tr></table>")).alias("html"),
    )
    whole = pages.catalogues({"service_UUIDs": services, "formats": pages.largest_table_rows(made)})
    return whole.select("kind", "number", "cname", "name")


# Kinds of a hundred numbers each, like the real lists.
@query(
    "catalog_export",
    """select 'kind_' || (p_partkey // 100) as kind, count(*) as n, cast(to_json(list([cast(p_partkey as varchar), lower(p_name), p_name]
      order by cast(p_partkey as varchar))) as varchar) as entries from part group by p_partkey // 100""",
)
def catalog_export(spark, folder):
    part = tables.table(spark, folder, "part")
    kind = F.concat(F.lit("kind_"), F.floor(F.col("p_partkey") / 100).cast("string"))
    table = part.select(
        kind.alias("kind"), F.col("p_partkey").alias("number"), F.lower("p_name").alias("cname"),
        F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"),
    )
    counts = table.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return pages.to_catalog(table).join(counts, "kind").select("kind", "n", "entries")

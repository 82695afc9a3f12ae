"""Levelled sorted runs: bucketed and sorted tables of keys that new batches are merge-joined against.

A run is a table bucketed and sorted by its key, so that merging a batch with
it moves no row of the run.  New runs go to level 0; as soon as a level holds
``fan`` runs they are compacted into one run of the next level, so n batches
leave at most (fan - 1) * log_fan(n) + 1 runs to look at.
"""

import uuid

from pyspark.sql import functions as F

from kinetable.session import scratch_path


class SortedRuns:
    """Runs of distinct keys in the shared folder.

    ``buckets`` is the number of files of a run; it follows
    ``spark.sql.shuffle.partitions``, which is set to the size of cluster and data.
    """

    def __init__(self, spark, keys, fan=3, buckets=None):
        self.spark, self.keys, self.fan = spark, list(keys), fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels, self.paths = [], {}

    def stored(self, rows):
        """Write ``rows`` as one bucketed and sorted table and give its name."""
        name = f"run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "run")
        first, *rest = self.keys
        kept = rows.write.bucketBy(self.buckets, first, *rest).sortBy(first, *rest)
        kept.option("path", self.paths[name]).saveAsTable(name)
        return name

    def forget(self, name):
        """Drop a table that nothing reads any more, and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def together(self, names):
        """All rows of the tables, dealt by key.

        The files are read as plain ones: Spark 4.1 takes a union of bucketed
        tables as dealt by their buckets even where it does not read them so.
        """
        whole = None
        for name in names:
            rows = self.spark.read.schema(self.spark.table(name).schema).parquet(self.paths[name])
            whole = rows if whole is None else whole.unionByName(rows)
        return whole.repartition(self.buckets, *self.keys)

    def names(self):
        return [name for level in self.levels for name in level]

    def tables(self):
        return [self.spark.table(name) for name in self.names()]

    def missing(self, batch):
        """Rows of a stored batch whose key stands in no run: one merge anti-join a run."""
        rows = self.spark.table(batch)
        for run in self.tables():
            rows = rows.join(run.select(*self.keys).hint("merge"), self.keys, "left_anti")
        return rows

    def add(self, rows):
        """Take a batch of distinct keys.

        The keys no run holds become a run of their own.  Returns the name of
        the table of the other rows: what the batch repeats.
        """
        batch = self.stored(rows)
        own = self.stored(self.missing(batch))
        seen = self.spark.table(batch).join(self.spark.table(own).select(*self.keys).hint("merge"), self.keys, "left_anti")
        repeats = self.stored(seen)
        self.forget(batch)
        self.put(own, 0)
        return repeats

    def put(self, run, level):
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            old = self.levels[level]
            merged = self.stored(self.together(old))
            self.levels[level] = []
            for name in old:
                self.forget(name)
            self.put(merged, level + 1)


def range_cuts(df, column, parts):
    """At most ``parts - 1`` values that cut ``column`` into ranges of about equal rows; one job."""
    steps = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, steps, 100 * parts).alias("q")).first()["q"] if steps else None
    return sorted(set(found or []))

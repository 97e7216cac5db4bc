"""Records of quoted text files, read by byte ranges.

Spark reads a large text file in ranges of its own choice, line by line. Whether a line starts inside a quoted cell (or a piece of JSON
inside a string) depends on everything before it, but only through one bit: a line is a function of that bit that is constant, leaves it, or flips it. So
each range first reports what it makes of either bit, a prefix over ranges (one narrow row each) gives every range its
true start, and then ranges cut their lines into records by themselves. What a range holds before its first record start
belongs to the record that an earlier range opened, and only such ends travel.

A record must fit in a row. Lines are put together again with line feeds, whatever ended them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE, RANGE, AT, SIZE = "_file", "_range", "_at", "_size"


def text_pieces(spark: SparkSession, folder: str, glob: str, separator: str | None = None) -> DataFrame:
    """Every line (or piece between separators) of the files below a folder with its file, range and place in the range."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if separator:
        reader = reader.option("lineSep", separator)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(RANGE),
        F.col("_metadata.file_size").alias(SIZE), F.monotonically_increasing_id().alias(AT), "value")


def _after(start: Column, zero: Column, one: Column) -> Column:
    """The bit behind a piece: ``zero`` and ``one`` are what it makes of either bit before it."""
    return F.when(start == 0, zero).otherwise(one)


def _scan(rows: DataFrame, by: list[str], order: str, zero: str, one: str) -> DataFrame:
    """Adds ``_after0`` and ``_after1``: the bit behind every row for either bit before the first row of its group.

    Behind the last row that is constant, the bit is its constant, flipped once for every flipping row since.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    constant, flips = F.col(zero) == F.col(one), (F.col(zero) != F.col(one)) & (F.col(zero) == 1)
    counted = rows.withColumn("_flips", F.sum(flips.cast("int")).over(upto))
    at_constant = counted.withColumn("_last", F.last(F.when(constant, F.struct(F.col(zero).alias("bit"), F.col("_flips").alias("flips"))), True).over(upto))
    turned = lambda bit, since: (bit + F.col("_flips") - since) % 2
    behind = lambda start: F.when(F.col("_last").isNotNull(), turned(F.col("_last.bit"), F.col("_last.flips"))).otherwise(turned(F.lit(start), F.lit(0)))
    return at_constant.withColumns({"_after0": behind(0).cast("int"), "_after1": behind(1).cast("int")}).drop("_flips", "_last")


def started(pieces: DataFrame, zero: Column, one: Column) -> DataFrame:
    """Adds ``inside``: the bit before every piece, 0 at the start of a file."""
    rows = _scan(pieces.withColumns({"_zero": zero.cast("int"), "_one": one.cast("int")}), [FILE, RANGE], AT, "_zero", "_one")
    ranges = rows.groupBy(FILE, RANGE).agg(F.max_by("_after0", AT).alias("_r0"), F.max_by("_after1", AT).alias("_r1"))
    before = Window.partitionBy(FILE).orderBy(RANGE)
    starts = _scan(ranges, [FILE], RANGE, "_r0", "_r1").select(
        F.col(FILE).alias("_f"), F.col(RANGE).alias("_r"), F.coalesce(F.lag("_after0").over(before), F.lit(0)).alias("_start"))
    met = rows.join(starts, (F.col(FILE) == F.col("_f")) & (F.col(RANGE) == F.col("_r")))
    own = Window.partitionBy(FILE, RANGE).orderBy(AT)
    inside = F.coalesce(F.lag(_after(F.col("_start"), F.col("_after0"), F.col("_after1"))).over(own), F.col("_start"))
    return met.withColumn("inside", inside).drop("_zero", "_one", "_after0", "_after1", "_start", "_f", "_r")


def records(pieces: DataFrame, opens: Column, separator: str = "\n") -> DataFrame:
    """``_file, pos, record``: pieces joined from each that ``opens`` a record up to the next; ``pos`` ascends in a file.

    Pieces before the first record of a file are left out.
    """
    own = Window.partitionBy(FILE, RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("_record", F.sum(opens.cast("int")).over(own))
    joined = numbered.groupBy(FILE, RANGE, "_record").agg(F.sort_array(F.collect_list(F.struct(AT, "value"))).alias("_p"))
    parts = joined.select(FILE, RANGE, "_record", F.array_join(F.transform("_p", lambda p: p["value"]), separator).alias("record"))
    # the end that a range holds of an earlier range's last record goes to that range
    last = numbered.groupBy(FILE, RANGE).agg(F.max("_record").alias("_n"))
    earlier = Window.partitionBy(FILE).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    owner = last.withColumn("_owner", F.last(F.when(F.col("_n") > 0, F.struct(F.col(RANGE).alias("r"), F.col("_n").alias("n"))), True).over(earlier))
    ends = parts.filter("_record = 0").join(owner.select(FILE, RANGE, "_owner"), [FILE, RANGE]).filter("_owner is not null")
    ends = ends.groupBy(F.col(FILE).alias("_f"), F.col("_owner.r").alias("_r"), F.col("_owner.n").alias("_m")).agg(
        F.sort_array(F.collect_list(F.struct(RANGE, "record"))).alias("_e"))
    ends = ends.select("_f", "_r", "_m", F.array_join(F.transform("_e", lambda e: e["record"]), separator).alias("_end"))
    met = parts.filter("_record > 0").join(
        ends, (F.col(FILE) == F.col("_f")) & (F.col(RANGE) == F.col("_r")) & (F.col("_record") == F.col("_m")), "left")
    whole = F.when(F.col("_end").isNull(), F.col("record")).otherwise(F.concat("record", F.lit(separator), "_end"))
    return met.select(FILE, (F.col(RANGE) + F.col("_record")).alias("pos"), whole.alias("record"))


def _odd(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) % 2 == 1


def quoted_lines(lines: DataFrame) -> DataFrame:
    """Lines of CSV with ``inside``: whether a line starts inside a quoted cell. A quote opens only at the start of a cell."""
    cells = F.split("value", ",", -1)

    def behind(start: int) -> Column:
        opened = lambda c: F.when(c.startswith('"') & _odd(c, '"'), 1).otherwise(0)
        closed = lambda c: F.when(_odd(c, '"'), 0).otherwise(1)
        return F.aggregate(cells, F.lit(start), lambda bit, c: F.when(bit == 0, opened(c)).otherwise(closed(c)))

    return started(lines, behind(0), behind(1))


def csv_records(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``_file, pos, record``: the records of all CSV files below a folder, quoted line ends included."""
    return records(quoted_lines(text_pieces(spark, folder, glob)), F.col("inside") == 0)


def json_objects(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``_file, pos, record, closed``: the objects of files that hold one JSON object or an array of objects.

    Files are cut behind closing braces; strings are told by the bit, and nesting is a running sum of brackets outside strings, over
    ranges as over pieces. ``closed``: all brackets and strings of the file end.
    """
    pieces = text_pieces(spark, folder, glob, "}")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, quotes only start and end strings
    flips = _odd(F.col("_bare"), '"').cast("int")
    rows = started(pieces.withColumn("_bare", bare), flips, 1 - flips)
    outside = F.array_join(F.filter(F.split("_bare", '"', -1), lambda _, i: (i + F.col("inside")) % 2 == 0), "")
    count = lambda marks: F.length("_out") - F.length(F.translate("_out", marks, ""))
    rows = rows.withColumn("_out", outside).withColumn("_ends", (F.col("inside") + flips) % 2)
    # the separator behind a piece closes an object unless it stands in a string; a file's last piece may have none
    rows = rows.withColumn("_step", count("{[") - count("]") - F.when(F.col("_ends") == 0, 1).otherwise(0)).drop("_out", "_bare")
    ranges = rows.groupBy(F.col(FILE).alias("_f"), F.col(RANGE).alias("_r")).agg(
        F.sum("_step").alias("_sum"), F.max_by("_ends", AT).alias("_bit"), F.max(AT).alias("_last"), F.max(SIZE).alias("_size"),
        F.sum(F.octet_length("value") + 1).alias("_bytes"), F.min_by(F.substring(F.ltrim("value"), 1, 1), AT).alias("_first"))
    before, file = Window.partitionBy("_f").orderBy("_r"), Window.partitionBy("_f")
    ranges = ranges.withColumns({
        "_base": F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_array": F.first("_first").over(before) == "[", "_ended": F.max(F.struct("_r", "_bit")).over(file)["_bit"],
        "_lacks": F.sum("_bytes").over(file) - F.col("_size"), "_total": F.sum("_sum").over(file)})
    # a byte order mark is in the size and in no piece
    unclosed = F.when(F.col("_lacks").isin(1, -2) & (F.col("_ended") == 0), 1).otherwise(0)
    ranges = ranges.withColumn("closed", (F.col("_ended") == 0) & (F.col("_total") + unclosed == 0)).select("_f", "_r", "_base", "_array", "closed")
    met = rows.join(ranges, (F.col(FILE) == F.col("_f")) & (F.col(RANGE) == F.col("_r"))).drop("_f", "_r")
    own = Window.partitionBy(FILE, RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col("_base") + F.sum("_step").over(own) - F.col("_step")
    opens = (F.col("inside") == 0) & (F.col("_depth") <= F.when(F.col("_array"), 1).otherwise(0))
    files = ranges.groupBy(F.col("_f").alias("_of")).agg(F.min("closed").alias("closed"))
    found = records(met.withColumn("_depth", depth), opens, "}").join(files, F.col(FILE) == F.col("_of")).drop("_of")
    body = F.concat(F.regexp_replace("record", "^[\\s,\\[\ufeff]+", ""), F.lit("}"))
    return found.withColumn("record", body).filter(F.col("record").startswith("{"))

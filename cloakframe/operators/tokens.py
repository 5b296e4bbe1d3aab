"""Token tables: building, auditing and analysing them without decryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fpe, native
from ..functions.elements import ALPHABETS, element
from ..functions.keys import TokenKey
from ..session import settle

TABLE_ELEMENTS = {"name": "name", "email": "email", "ssn": "ssn", "dob": "digits"}


def element_of_column(column: str, elements: dict[str, str] | None = None) -> str:
    """Element of a column: as mapped by the caller, else by the table above, else of the column's own name."""
    found = (elements or {}).get(column) or TABLE_ELEMENTS.get(column) or column
    if found not in ALPHABETS:
        raise ValueError(f"no element is known for column {column!r}; map it to one of {sorted(ALPHABETS)}")
    return found


def tokenize_table(
    df: DataFrame, elements: dict[str, str] | None = None, key: TokenKey | None = None, **options
) -> DataFrame:
    """Replace columns by their tokens; same schema, same widths, other columns untouched."""
    return _replace(df, fpe.encrypt, elements, key, options)


def detokenize_table(
    df: DataFrame, elements: dict[str, str] | None = None, key: TokenKey | None = None, **options
) -> DataFrame:
    return _replace(df, fpe.decrypt, elements, key, options)


def _replace(df, function, elements, key, options):
    chosen = TABLE_ELEMENTS if elements is None else elements
    return df.withColumns({c: function(c, e, key, **options) for c, e in chosen.items() if c in df.columns})


def roundtrip_sample(
    clear: DataFrame, tokens: DataFrame, rows: int = 3, columns: tuple[str, ...] = ("ssn", "email"),
    key: TokenKey | None = None,
) -> DataFrame:
    """The first few ids with clear value, token and decrypted token side by side."""
    sides = clear.select("id", *[F.col(c).alias(f"{c}_clear") for c in columns]).join(
        tokens.select("id", *[F.col(c).alias(f"{c}_tokenized") for c in columns]), "id"
    )
    return sides.orderBy("id").limit(rows).select(
        "*", *[fpe.decrypt(f"{c}_tokenized", element_of_column(c), key).alias(f"{c}_roundtrip") for c in columns]
    )


def roundtrip_audit(
    clear: DataFrame, tokens: DataFrame, column: str = "ssn", every: int = 1, key: TokenKey | None = None
) -> DataFrame:
    """Rows whose decrypted token differs from the clear value, and rows checked.  ``every=1000`` checks a
    thousandth; the filter runs below the decryption on both sides."""
    chosen = F.col("id") % every == 0
    pairs = (
        clear.filter(chosen)
        .select("id", F.col(column).alias("clear"))
        .join(tokens.filter(chosen).select("id", F.col(column).alias("token")), "id")
    )
    differs = fpe.decrypt("token", element_of_column(column), key) != F.col("clear")
    return pairs.agg(F.count_if(differs).alias("mismatches"), F.count("*").alias("checked"))


def forced_length(df: DataFrame, value: Column, output: str = "total_length") -> DataFrame:
    """Sum of lengths: forces a transform over every row while one number comes back."""
    return df.agg(F.sum(F.length(value)).alias(output))


def count_transformed(df: DataFrame, value: Column, output: str = "transformed") -> DataFrame:
    return df.agg(F.count(value).alias(output))


def distinct_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """COUNT(DISTINCT) on tokens.  Tokens are one to one with values, so nothing is decrypted."""
    return df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


def distinct_after_decrypt(df: DataFrame, columns: list[str], key: TokenKey | None = None) -> DataFrame:
    """The same answer the slow way, every row decrypted first; kept as the comparison."""
    clear = detokenize_table(df, {c: element_of_column(c) for c in columns}, key)
    return distinct_tokens(clear, columns)


def limit_then_decrypt(df: DataFrame, column: str, rows: int, key: TokenKey | None = None) -> DataFrame:
    """Decrypt only the first ``rows`` ids."""
    return df.orderBy("id").limit(rows).select("id", fpe.decrypt(column, element_of_column(column), key).alias(column))


def decrypt_then_limit(df: DataFrame, column: str, rows: int, key: TokenKey | None = None) -> DataFrame:
    return df.select("id", fpe.decrypt(column, element_of_column(column), key).alias(column)).orderBy("id").limit(rows)


def filter_then_decrypt(df: DataFrame, column: str, condition: Column, key: TokenKey | None = None) -> DataFrame:
    """Filter on clear columns, then decrypt what is left, unconditionally."""
    return df.filter(condition).withColumn(column, fpe.decrypt(column, element_of_column(column), key))


def decrypt_then_filter(df: DataFrame, column: str, condition: Column, key: TokenKey | None = None) -> DataFrame:
    """Same rows; Catalyst pushes the filter below the (deterministic) decryption by itself."""
    return df.withColumn(column, fpe.decrypt(column, element_of_column(column), key)).filter(condition)


def decrypt_where(df: DataFrame, column: str, condition: Column, key: TokenKey | None = None) -> DataFrame:
    """CASE WHEN condition THEN decrypt(x) ELSE x END, with the condition inside the argument: a value
    outside it reaches the function only as NULL and is never decrypted in memory."""
    decoded = fpe.decrypt(F.when(condition, F.col(column)), element_of_column(column), key)
    return df.withColumn(column, F.when(condition, decoded).otherwise(F.col(column)))


def decrypt_case(df: DataFrame, column: str, condition: Column, key: TokenKey | None = None) -> DataFrame:
    """The plain CASE shape; the function then runs over every row.  Kept as the comparison."""
    decoded = fpe.decrypt(column, element_of_column(column), key)
    return df.withColumn(column, F.when(condition, decoded).otherwise(F.col(column)))


def decrypt_hoisted(df: DataFrame, column: str, condition: Column, key: TokenKey | None = None) -> DataFrame:
    """Decrypt in a subquery and choose outside; the same work as :func:`decrypt_case`."""
    inner = df.withColumn("_decoded", fpe.decrypt(column, element_of_column(column), key))
    return inner.withColumn(column, F.when(condition, F.col("_decoded")).otherwise(F.col(column))).drop("_decoded")


_COPIES_AT_ONCE = 10_000


def replicate(df: DataFrame, rows: int, by: str = "id") -> DataFrame:
    """Exactly ``rows`` rows by repeating the table; the remainder repeats the rows first in the order of ``by``
    (any sortable type; of equal ones some).  Rows are numbered over range partitions of ``by``, by the rows of
    each partition and not in one place, and the numbered table is stored so that the numbers hold."""
    have = df.count()
    if have == 0:
        return df
    full, rest = divmod(rows, have)
    copies = F.lit(full).cast("long")
    if rest:
        ordered = df.repartitionByRange(by).sortWithinPartitions(by)
        df = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
        part = F.shiftright("_at", 33)
        sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # a row for each partition
        starts = sizes.select("_part", before.alias("_before"))
        numbered = df.withColumn("_part", part).join(starts, "_part")
        number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
        df = numbered.withColumn("_copies", copies + F.when(number < rest, 1).otherwise(0)).drop("_at", "_part", "_before")
    else:
        df = df.withColumn("_copies", copies)
    # copies are counted out in two steps, so that no array is long however few rows there are
    step = F.lit(_COPIES_AT_ONCE)
    blocks = df.filter("_copies > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / step))))
    first = F.col("_block") * step + 1
    last = F.least(first + step - 1, F.col("_copies"))
    return blocks.withColumn("copy", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_copies", "_block")


def wide_values(df: DataFrame, value: Column, width: int, output: str = "wide") -> DataFrame:
    """Widen every value by repetition to ``width`` characters (1 MB chunks are concatenated).  Only the value itself is
    cut, for the end of a chunk, so no wide text is gone through to make it."""
    chunk = 1_000_000
    length = F.greatest(F.length(value), F.lit(1))

    def piece(size: int) -> Column:
        return F.concat(F.repeat(value, F.floor(F.lit(size) / length).cast("int")), F.substring(value, F.lit(1), (F.lit(size) % length).cast("int")))

    full, rest = divmod(width, chunk)
    pieces = ([F.repeat(piece(chunk), F.lit(full))] if full else []) + ([piece(rest)] if rest else [])
    return df.withColumn(output, F.concat(*pieces) if pieces else F.substring(value, 1, 0))


# --- fixed values: request budget and punctuation cost of one call in the wire format ------------------
REQUEST_BYTES = 261_900
BYTES_PER_ARGUMENT = 3
BYTES_PER_CALL = 2
# ------------------------------------------------------------------------------------------------------


def wire_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, called as f(value, element): rows a request can hold, requests for the table, and the
    estimated reply size in MB.  One row per column from one aggregate pass."""
    sizes = df.agg(
        F.count("*").alias("total"),
        *[F.sum(F.octet_length(c)).alias(f"_{c}") for c in columns],
    )
    argument = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(len(element_of_column(c))))])
    per_column = sizes.select(
        "total", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{c}").alias("bytes")) for c in columns])).alias("s")
    ).select("total", "s.*")
    call = F.col("average_bytes") + argument[F.col("column")] + 2 * BYTES_PER_ARGUMENT + BYTES_PER_CALL
    return (
        per_column.withColumn("average_bytes", F.try_divide("bytes", "total"))
        .withColumn("rows_per_request", F.floor(REQUEST_BYTES / call))
        .withColumn("requests", F.ceil(F.try_divide("total", "rows_per_request")))
        .withColumn("reply_mb", F.col("rows_per_request") * F.col("average_bytes") / 1_000_000)
        .select("column", "total", "average_bytes", "rows_per_request", "requests", "reply_mb")
    )


def size_batches(df: DataFrame, value: str, max_rows: int, max_bytes: int) -> DataFrame:
    """Give each row a batch (partition, number within it) so that no batch exceeds ``max_rows`` rows or
    ``max_bytes`` bytes of ``value``; a single larger row goes alone.  Partitions are packed
    independently and streamed, so no shuffle and no partition held in memory.  Numbers follow the order of
    the rows, so pack a stored table."""
    schema = T.StructType([*df.schema.fields, T.StructField("batch_partition", T.IntegerType()), T.StructField("batch", T.LongType())])
    at = df.columns.index(value)

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        number, rows, used = 0, 0, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(sizes)))
            numbers = np.empty(len(sizes), np.int64)
            begin = 0
            while begin < len(sizes):  # one step for each pack, not for each row
                fits = int(np.searchsorted(sums, sums[begin] + max_bytes - used, "right")) - 1
                end = min(max(fits, begin), begin + max_rows - rows, len(sizes))
                if end == begin and not rows:
                    end = begin + 1  # larger than a pack: it goes alone
                numbers[begin:end] = number
                rows, used = rows + end - begin, used + int(sums[end] - sums[begin])
                if end < len(sizes):
                    number, rows, used = number + 1, 0, 0
                begin = end
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([partition] * len(sizes), pa.int32()), pa.array(numbers)], names=schema.names
            )

    return df.mapInArrow(pack, schema)


def short_value_report(df: DataFrame, elements: dict[str, str] | None = None) -> DataFrame:
    """Per column: values, those passed through unchanged, and e-mails that keep capitals in clear."""
    chosen = {c: e for c, e in (elements or TABLE_ELEMENTS).items() if c in df.columns}
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.lit(element(e).name).alias("element"),
                        F.col(c).isNotNull().alias("present"),
                        native.passes_through(c, e).alias("short"),
                        (native.keeps_clear_letters(c) if e == "email" else F.lit(False)).alias("capitals"),
                    )
                    for c, e in chosen.items()
                ]
            )
        ).alias("s")
    ).select("s.*")
    return long.groupBy("column", "element").agg(
        F.count_if("present").alias("present"),
        F.count_if("short").alias("passed_through"),
        F.count_if("capitals").alias("with_capitals"),
    )

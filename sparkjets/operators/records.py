"""Record to many records as a table function, for records whose shape is known only at run time.

``explode_aligned`` and ``explode_to_scalars`` are the fast way where the columns can be
named in the plan. This one looks at the schema of whatever table it is given and says
itself what it returns; it takes a whole table, by partitions of a key where that is asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _scalar(kind: T.DataType, levels: int) -> T.DataType:
    while levels and isinstance(kind, T.ArrayType):
        kind, levels = kind.elementType, levels - 1
    return kind


class Unpack:
    """Arrays whose names start with the prefix are unpacked in step, ``levels`` deep; other columns are repeated.

    ``index`` names the columns that hold the places, one per level: ``<index>``,
    ``<index>_2``, ... Records without elements vanish; arrays of unequal length end with NULLs.
    """

    @staticmethod
    def analyze(records: AnalyzeArgument, prefix: AnalyzeArgument, levels: AnalyzeArgument, index: AnalyzeArgument) -> AnalyzeResult:
        fields, depth = [], 0
        for f in records.dataType.fields:
            arrays = 0
            kind = f.dataType
            while f.name.startswith(prefix.value) and isinstance(kind, T.ArrayType) and arrays < levels.value:
                kind, arrays = kind.elementType, arrays + 1
            depth = max(depth, arrays)
            fields.append(T.StructField(f.name, kind, True))
        places = [T.StructField(index.value if n == 0 else f"{index.value}_{n + 1}", T.IntegerType()) for n in range(depth)]
        return AnalyzeResult(T.StructType([*fields, *places]))

    def eval(self, records, prefix: str, levels: int, index: str) -> Iterator[tuple]:
        names = records.__fields__
        columns = [(tuple(records), ())]
        for _ in range(levels):
            below, deeper = [], False
            for values, places in columns:
                own = [i for i, (n, v) in enumerate(zip(names, values)) if n.startswith(prefix) and isinstance(v, (list, tuple)) and not hasattr(v, "__fields__")]
                if not own:
                    if any(n.startswith(prefix) and v is None for n, v in zip(names, values)):
                        continue  # no array at all: nothing to unpack
                    below.append((values, places))
                    continue
                deeper = True
                for place in range(max(len(values[i]) for i in own)):
                    row = list(values)
                    for i in own:
                        row[i] = values[i][place] if place < len(values[i]) else None
                    below.append((tuple(row), (*places, place)))
            columns = below
            if not deeper:
                break
        for values, places in columns:
            yield (*values, *places)


unpack = F.udtf(Unpack)


def unpack_records(
    df: DataFrame, prefix: str, levels: int = 1, index: str = "index", partition_by: Sequence[str] = ()
) -> DataFrame:
    """``df`` with the arrays named ``prefix...`` unpacked by the table function :class:`Unpack`."""
    table = df.asTable()
    table = table.partitionBy(*partition_by) if partition_by else table
    return unpack(table, F.lit(prefix), F.lit(levels), F.lit(index))

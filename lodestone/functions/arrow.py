"""Arrow functions over columns: only their arguments go to Python, the other columns of a row stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(run: Callable[[Iterator], Iterator[pa.Array]], schema: T.DataType):
    """An Arrow function over an iterator of batches (tuples of arrays).

    Marked as nondeterministic: else the optimiser would repeat it where a filter or several columns need its result.
    """
    return F.arrow_udf(run, schema, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()

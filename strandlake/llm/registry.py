"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op6_minhash as minhash
from .op1_licenses import op1_licenses
from .op2_warc import ORACLE as WARC_ORACLE
from .op2_warc import op2_warc
from .op3_mixing import op3_mixing
from .op4_merkle import op4_merkle
from .op5_topk import op5_topk
from .op6_minhash import op6_minhash
from .op7_passages import op7_passages
from .op8_ppm import op8_ppm
from .op9_packing import op9_packing
from .op10_langid import op10_langid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_merkle": op4_merkle,
    "op5_topk": op5_topk,
    "op6_minhash": op6_minhash,
    "op7_passages": op7_passages,
    "op8_ppm": op8_ppm,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
}

ORACLES: dict[str, str] = {
    "op2_warc": WARC_ORACLE,
    "op6_minhash": minhash.ORACLE,
}

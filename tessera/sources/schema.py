"""Schemas of the property graph's tables."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in map(str.split, text.split(","))])


_KINDS = {"long": T.LongType, "int": T.IntegerType, "string": T.StringType, "byte": T.ByteType, "binary": T.BinaryType, "boolean": T.BooleanType, "double": T.DoubleType}

EDGE = _struct("src long, atype long, dst long, time long, attr string")
NODE_ATTR = _struct("node_id long, attr_idx int, attr string")
NODE = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("attrs", T.ArrayType(T.StringType()))])
LINK = _struct("id1 long, id2 long, link_type long, visibility byte, version int, time long, data binary")
LINK_OP = _struct("seq long, op string, id1 long, link_type long, id2 long, visibility byte, version int, time long, data binary")
LINK_NODE = _struct("id long, type int, version long, time int, data binary")
TOMBSTONE = _struct("src long, atype long, dst long, seq long")
LATENCY = _struct("thread int, op string, ts long, latency_us long, error boolean")
LABELLED_EDGE = _struct("i long, j long, cost double")
EMPIRICAL = _struct("value int, probability double")

#: Batch requests: one row a call, results carry req_id.
REQUEST_NODE = _struct("req_id long, node long")
REQUEST_LIST = _struct("req_id long, src long, atype long")
REQUEST_RANGE = _struct("req_id long, src long, atype long, off int, len int")
REQUEST_TIME = _struct("req_id long, src long, atype long, t_low long, t_high long, limit int")
REQUEST_GET = T.StructType([*_struct("req_id long, src long, atype long").fields, T.StructField("dst_set", T.ArrayType(T.LongType())), *_struct("t_low long, t_high long").fields])

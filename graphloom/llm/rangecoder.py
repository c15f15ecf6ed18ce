"""The range coder of ``TokenCoder.java`` as functions of Spark columns.

A coder takes one decision after the other, which neither DataFrame functions nor numpy can do
at speed, so it is a small Java class. Spark's own compiler of generated code (Janino) compiles
it on the driver when first needed; the class goes to the executors as a jar. No build step,
no compiler on the machines.
"""

from __future__ import annotations

import io
import zipfile
from importlib.resources import files

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import put_file

_CLASS = "graphloom.TokenCoder"
_loaded: dict[str, object] = {}


def _functions(spark: SparkSession) -> None:
    """Compiles and ships the class once per application, and names its functions in the session."""
    sc, jvm = spark.sparkContext, spark._jvm
    loader = _loaded.get(sc.applicationId)
    if loader is None:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(files("graphloom.llm").joinpath("TokenCoder.java").read_text())
        jar, classes = io.BytesIO(), compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as out:
            for name in classes.keySet():
                out.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
        sc._jsc.addJar(put_file(spark, "token-coder.jar", jar.getvalue()))
        loader = compiler.getClassLoader()
        _loaded.clear()
        _loaded[sc.applicationId] = loader
    binary = spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("binary")
    for name in ("Encode", "Decode"):
        made = loader.loadClass(f"{_CLASS}${name}").getDeclaredConstructor(sc._gateway.new_array(jvm.Class, 0)).newInstance(sc._gateway.new_array(jvm.Object, 0))
        spark._jsparkSession.udf().register(f"graphloom_{name.lower()}_ids", made, binary)


def encode_ids(spark: SparkSession, ids: str) -> Column:
    """Ids below 65,536 as little-endian unsigned 32-bit integers -> payload of checksummed blocks; null stays null."""
    _functions(spark)
    return F.call_function("graphloom_encode_ids", F.col(ids))


def decode_ids(spark: SparkSession, payload: str) -> Column:
    """Payload -> ids; damage fails the query."""
    _functions(spark)
    return F.call_function("graphloom_decode_ids", F.col(payload))

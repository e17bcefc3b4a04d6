"""Java classes of this package: Spark's own compiler makes them, its file service hands them out."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], object] = {}


def java_object(spark: SparkSession, name: str):
    """A new object of the class `shoal.<name>` in <name>.java, which every executor can read."""
    context = spark.sparkContext
    jvm = context._jvm
    key = (context.applicationId, name)
    if key not in _made:
        above = jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(above)
        compiler.cook(pkgutil.get_data(__package__, f"{name}.java").decode())
        jar = os.path.join(tempfile.mkdtemp(prefix="shoal-"), f"shoal-{name}.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for inner, code in compiler.getBytecodes().items():
                out.writestr(inner.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(jar)
        urls = context._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(jar).toURI().toURL()
        _made[key] = jvm.java.net.URLClassLoader(urls, above).loadClass(f"shoal.{name}")
    return _made[key].getDeclaredConstructor(context._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))


def map_rows(rows: DataFrame, function, schema: str) -> DataFrame:
    """What a Java MapPartitionsFunction makes of the rows of each task."""
    jvm = rows.sparkSession.sparkContext._jvm
    out = rows._jdf.mapPartitions(function, jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(schema)))
    return DataFrame(out, rows.sparkSession)

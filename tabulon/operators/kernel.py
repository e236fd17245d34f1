"""Functions in Java beside the expressions: ``trees.java`` and ``near.java``, compiled by the compiler that Spark brings for its own code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

_SOURCES = [Path(__file__).with_name(n) for n in ("trees.java", "near.java")]  # one unit: the imports are the first one's
FUNCTIONS = {
    "tabulon_grid_forest": ("GridForest", "array<binary>"),
    "tabulon_held_forest": ("HeldForest", "array<array<double>>"),
    "tabulon_tiled_forest": ("TiledForest", "array<array<double>>"),
    "tabulon_put_file": ("PutFile", "long"),
    "tabulon_near_graph": ("NearGraph", "array<double>"),
}
_made: dict[str, tuple] = {}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; executors get their classes as a jar from the driver."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook("\n".join(p.read_text() for p in _SOURCES))
        folder = tempfile.mkdtemp(prefix="tabulon-jar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/tabulon-trees.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        _made[app] = jar, compiler.getClassLoader()
    jar, classes = _made[app]
    spark.sql(f"ADD JAR '{jar}'")
    for name, (of, returns) in FUNCTIONS.items():
        returned = spark._jsparkSession.parseDataType(_parse_datatype_string(returns).json())
        spark._jsparkSession.udf().register(name, classes.loadClass(of).newInstance(), returned)


def folders(spark: SparkSession):
    """What deletes folders, at once or when an object of the driver is no longer in use."""
    register(spark)
    return _made[spark.sparkContext.applicationId][1].loadClass("Kept").newInstance()


def settings(*numbers: float) -> bytes:
    return np.array(numbers, "<f8").tobytes()

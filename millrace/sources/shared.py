"""The folder that driver and executors share, files that executors open themselves, and the code they need."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
import zlib
from pathlib import Path
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, in local sessions only, below a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(df: DataFrame) -> DataFrame:
    """df, once this package's code is among the files that Spark hands to its Python workers.

    A session may have been started without the package on the workers' path; its file server reaches every executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        folder = Path(tempfile.mkdtemp(prefix="millrace-code-"))
        with zipfile.ZipFile(folder / "millrace_code.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(folder / "millrace_code.zip"))
        _shipped.add(sc.applicationId)
    return df


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as ``open_folder`` takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{quote(uri.getPath())}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


_SPECIAL = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{[\]^]""")


def key_file(keys: list[str], values: list[str | None], folders: int = 0) -> str:
    """The file of a key: page.html in folders named as Spark names those of partitions, or, given a number of folders,
    one of so many folders by a hash, and the key in the file's name. An empty value, which Spark takes for null, is %."""
    name = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else _SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", v) or "%"
    parts = [f"{k}={name(v)}" for k, v in zip(keys, values)]
    if not folders:
        return "/".join([*parts, "page.html"])
    own = ",".join(parts)
    return f"{zlib.crc32(own.encode()) % folders}/{own}.html"

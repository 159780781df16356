"""Tables that are replaced as a whole, or bucket by bucket.

Spark cannot overwrite what it is reading. Every replacement is written to a
new folder with a name of its own and then committed by a numbered marker file
that names the folders; readers follow the highest marker. A marker is written
aside and renamed into place, so it is whole as soon as it is seen, and of two
writers that commit one number the second fails. A run that dies before its
marker leaves nothing that readers see or later writers meet; ``sweep`` removes
such folders.

A marker may name several tables that change together, or one folder for each
bucket of the keys, of which the next version rewrites only some. It also
carries the last batch that each stream has applied.
"""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tollwatch.sources.tables import read_or_none

BUCKET = "_bucket"


def _fs(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _path(spark, text):
    return spark._jvm.org.apache.hadoop.fs.Path(text)


def _names(spark, path):
    fs, folder = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _numbers(spark, path):
    return sorted(int(n) for n in _names(spark, f"{path}/_committed") if n.isdigit())


def _marker(spark, path, version):
    """Contents of a marker, or None for one that cannot be read."""
    fs, name = _fs(spark, f"{path}/_committed/{version}")
    stream = fs.open(name)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def committed_versions(spark, path):
    """Numbers of the committed versions, ascending."""
    return [v for v in _numbers(spark, path) if _marker(spark, path, v)]


def _newest(spark, path, at_most=None):
    for version in reversed(_numbers(spark, path)):
        if at_most is None or version <= at_most:
            marker = _marker(spark, path, version)
            if marker:
                return version, marker
    return None, {}


def latest_version(spark, path, at_most=None):
    """Highest committed version, or None; only the newest markers are opened."""
    return _newest(spark, path, at_most)[0]


def read_version(spark, path, schema=None, at_most=None, name=None):
    """Newest committed contents, or None before the first write.

    ``name`` is one of the tables that were committed together.
    """
    version, marker = _newest(spark, path, at_most)
    return None if version is None else _contents(spark, path, marker, schema, name)


def _contents(spark, path, marker, schema=None, name=None):
    if "buckets" in marker:
        schema = schema or StructType.fromJson(marker["schema"])
        folders = [f"{path}/{f}" for f in marker["buckets"].values()]
        return spark.read.schema(schema).parquet(*folders) if folders \
            else spark.createDataFrame([], schema)
    folder = marker["folder"] if name is None else marker["folders"][name]
    return read_or_none(spark, f"{path}/{folder}", schema)


def last_batch(spark, path, stream):
    """Number of the last batch of a stream that the table holds, or None."""
    return _newest(spark, path)[1].get("streams", {}).get(stream)


def commit(spark, path, entry, base=None, stream=None):
    """Make ``entry`` the next version; returns its number.

    ``base`` is the version that it was made from (0 for none): if another
    writer has committed since, this one fails. ``stream`` is a stream and the
    number of the batch that is applied with it.
    """
    newest, marker = _newest(spark, path)
    if base is not None and (newest or 0) != base:
        raise RuntimeError(f"{path} has been replaced since version {base}")
    streams = {**marker.get("streams", {}), **(dict([stream]) if stream else {})}
    version = max(_numbers(spark, path), default=0) + 1
    fs, aside = _fs(spark, f"{path}/_committed/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps({**entry, "streams": streams}).encode()))
    finally:
        out.close()
    # without options this rename fails where the target exists
    none = spark._sc._gateway.new_array(
        getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, _path(spark, f"{path}/_committed/{version}"), none)
    return version


def overwrite_state(df, path, base=None, stream=None):
    """Write ``df`` as the next version and commit it; returns its number."""
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return commit(df.sparkSession, path, {"folder": folder}, base, stream)


def overwrite_together(frames, path, base=None):
    """Write several named tables and commit them as one version; returns its number."""
    folders = {}
    for name, df in frames.items():
        folders[name] = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{folders[name]}")
        spark = df.sparkSession
    return commit(spark, path, {"folders": folders}, base)


def bucket_of(key, n):
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def upsert_buckets(batch, path, merge, key, touches=(), n=64, stream=None):
    """Apply ``merge(old, batch)`` to the buckets that the batch touches; returns the version.

    Rows are kept in ``n`` buckets by a hash of ``key``. Only buckets with a key
    of ``batch`` or of the frames ``touches`` are read, merged and written; the
    others are named again. ``merge`` must treat keys independently and keep
    the columns. A table of another form or number of buckets is dealt out by
    the first call. At most ``n`` bucket numbers come to the driver.
    """
    spark = batch.sparkSession
    base, marker = _newest(spark, path)
    bucketed = marker.get("n") == n
    if bucketed:
        found = None
        for frame in (batch, *touches):
            own = frame.select(bucket_of(key, n).alias("b"))
            found = own if found is None else found.union(own)
        hit = sorted(r.b for r in found.distinct().collect())
        kept = {k: f for k, f in marker["buckets"].items() if int(k) not in hit}
        read = {k: f for k, f in marker["buckets"].items() if int(k) in hit}
        old = _contents(spark, path, {**marker, "buckets": read}, batch.schema)
    else:
        kept = {}
        old = spark.createDataFrame([], batch.schema) if base is None \
            else _contents(spark, path, marker, batch.schema)
    folder = f"data-{uuid.uuid4().hex}"
    merged = merge(old, batch).withColumn(BUCKET, bucket_of(key, n))
    merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    new = {name.partition("=")[2]: f"{folder}/{name}" for name in _names(spark, f"{path}/{folder}")
           if name.startswith(BUCKET + "=")}
    entry = {"buckets": {**kept, **new}, "n": n, "schema": batch.schema.jsonValue()}
    return commit(spark, path, entry, base or 0, stream)


def _folders(marker):
    """Folders that a marker names."""
    return {f for f in [marker.get("folder"), *marker.get("folders", {}).values(),
                        *marker.get("buckets", {}).values()] if f}


def drop_old_versions(spark, path, keep=2):
    """Delete all but the newest ``keep`` committed versions.

    Frames over an older version can no longer be read afterwards. Folders that
    a kept version names too stay.
    """
    if keep < 1:
        raise ValueError("at least one version must be kept")
    versions = committed_versions(spark, path)
    dropped, kept = versions[:-keep], versions[-keep:]
    named = set().union(*(_folders(_marker(spark, path, v)) for v in kept)) if kept else set()
    fs, _ = _fs(spark, path)
    for version in dropped:
        folders = _folders(_marker(spark, path, version)) - named
        fs.delete(_path(spark, f"{path}/_committed/{version}"), False)
        for folder in folders:
            fs.delete(_path(spark, f"{path}/{folder}"), True)
            top = folder.partition("/")[0]
            if top != folder and not any(f.startswith(top + "/") for f in named):
                fs.delete(_path(spark, f"{path}/{top}"), True)
    return dropped


def sweep(spark, path, older_than=24 * 3600):
    """Delete data folders and markers written aside that no version names; returns their names.

    Only what is older than ``older_than`` seconds goes, since a running writer
    has not committed its folder yet.
    """
    named = {f.partition("/")[0] for v in committed_versions(spark, path)
             for f in _folders(_marker(spark, path, v))}
    fs, folder = _fs(spark, path)
    limit = spark._jvm.System.currentTimeMillis() - 1000 * older_than
    gone = []
    for place, start in ((path, "data-"), (f"{path}/_committed", ".")):
        fs, folder = _fs(spark, place)
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            aside = name.startswith(start) and not name.endswith(".crc")
            if aside and name not in named and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)

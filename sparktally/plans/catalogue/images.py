"""Image statistics on images made from the embeddings: 8 x 8 pixels, three channels."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from sparktally.operators import images as I
from sparktally.plans.fixtures import table
from sparktally.plans.registry import query
from sparktally.session import scratch_path
from sparktally.sources.tables import pixels_hex, read_images


def embedding_images(spark, sf):
    """Image structs: value v of a dimension gives blue v, green 255 - v, red v // 2."""
    level = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    pixels = F.flatten(F.transform(level, lambda v: F.array(v, 255 - v, F.floor(v / 2).cast("int"))))
    return table(spark, sf, "embeddings").select("vec_id", F.struct(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("origin"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        pixels_hex(pixels).alias("data")).alias("image"))


_LEVELS = """lv AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER))) AS v FROM embeddings),
px AS (SELECT vec_id, v / 255::DOUBLE AS b, (255 - v) / 255::DOUBLE AS g, floor(v / 2) / 255::DOUBLE AS r FROM lv),
al AS (SELECT vec_id, b AS x FROM px UNION ALL SELECT vec_id, g FROM px UNION ALL SELECT vec_id, r FROM px),
st AS (SELECT concat('vec-', CAST(px.vec_id AS VARCHAR)) AS origin, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b,
  stddev_pop(r) AS std_r, stddev_pop(g) AS std_g, stddev_pop(b) AS std_b FROM px GROUP BY vec_id),
tot AS (SELECT concat('vec-', CAST(vec_id AS VARCHAR)) AS origin, avg(x) AS mean, stddev_pop(x) AS std FROM al GROUP BY vec_id)"""


@query("image_dims", """
SELECT concat('vec-', CAST(vec_id AS VARCHAR)) AS origin, 8::BIGINT AS width, 8::BIGINT AS height, 3::BIGINT AS channels FROM embeddings""")
def image_dims(spark, sf):
    return I.image_dims(embedding_images(spark, sf))


@query("image_stats", f"""WITH {_LEVELS}
SELECT origin, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, ROUND(mean_r, 6) AS mean_r, ROUND(mean_g, 6) AS mean_g,
  ROUND(mean_b, 6) AS mean_b, ROUND(std_r, 6) AS std_r, ROUND(std_g, 6) AS std_g, ROUND(std_b, 6) AS std_b
FROM st JOIN tot USING (origin)""")
def image_stats(spark, sf):
    return I.image_stats(embedding_images(spark, sf)).select("origin", *[F.round(s, 6).alias(s) for s in I.STATS])


@query("dataset_mean_std", f"""WITH {_LEVELS},
drawn AS (SELECT * FROM st ORDER BY md5(origin), origin LIMIT 64)
SELECT COUNT(*) AS images, ROUND(AVG(mean_r), 6) AS mean_r, ROUND(AVG(mean_g), 6) AS mean_g, ROUND(AVG(mean_b), 6) AS mean_b,
  ROUND(AVG(std_r), 6) AS std_r, ROUND(AVG(std_g), 6) AS std_g, ROUND(AVG(std_b), 6) AS std_b FROM drawn""")
def dataset_mean_std(spark, sf):
    out = I.dataset_mean_std(embedding_images(spark, sf), k=64)
    return out.select("images", *[F.round(s, 6).alias(s) for s in I.STATS if "_" in s])


def _bitmap(data: bytes, width: int, height: int) -> bytes:
    """A 24-bit bitmap file; rows run from the bottom up and fill four bytes."""
    line = width * 3
    pad = -line % 4
    body = b"".join(data[y * line : (y + 1) * line] + b"\0" * pad for y in reversed(range(height)))

    def words(*values: tuple[int, int]) -> bytes:
        return b"".join(v.to_bytes(size, "little") for v, size in values)

    head = b"BM" + words((54 + len(body), 4), (0, 4), (54, 4))
    info = words((40, 4), (width, 4), (height, 4), (1, 2), (24, 2), (0, 4), (len(body), 4), (2835, 4), (2835, 4), (0, 4), (0, 4))
    return head + info + body


def write_bitmaps(images, folder: str) -> int:
    """Write every image struct as a file below ``folder``, each by the task that holds it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for vec_id, width, height, data in batch.itertuples(index=False, name=None):
                system.create_dir(f"{root}/part-{vec_id % 7}", recursive=True)
                ending = "BMP" if vec_id % 2 else "bmp"
                with system.open_output_stream(f"{root}/part-{vec_id % 7}/vec-{vec_id}.{ending}") as out:
                    out.write(io.BytesIO(_bitmap(data, width, height)).getbuffer())
            yield pd.DataFrame({"n": [len(batch)]})

    flat = images.select("vec_id", "image.width", "image.height", "image.data")
    return flat.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


@query("read_images", f"""WITH {_LEVELS}
SELECT origin, 8::BIGINT AS width, 8::BIGINT AS height, ROUND(mean_r, 6) AS mean_r, ROUND(mean_g, 6) AS mean_g, ROUND(mean_b, 6) AS mean_b FROM st""")
def read_images_query(spark, sf):
    folder = scratch_path(spark, "images")
    write_bitmaps(embedding_images(spark, sf), folder)
    images = read_images(spark, folder)
    name = F.regexp_extract("origin", r"(vec-\d+)\.", 1)
    dims = I.image_dims(images).select(name.alias("origin"), "width", "height")
    means = [f"mean_{c}" for c in "rgb"]
    stats = I.image_stats(images).select(name.alias("origin"), *[F.round(m, 6).alias(m) for m in means])
    return dims.join(stats, "origin")

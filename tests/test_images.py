import struct
import zlib

import numpy as np
import pytest

from sparktally.operators import images as I
from sparktally.sources.tables import read_images


def png(pixels: np.ndarray) -> bytes:
    """Minimal PNG of an H x W x C uint8 array, C being 1, 3 or 4."""
    h, w, c = pixels.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    body = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    r = np.random.default_rng(1)
    arrays = {
        "a.png": r.integers(0, 256, (4, 6, 3), dtype=np.uint8),
        "b.PNG": r.integers(0, 256, (5, 3, 4), dtype=np.uint8),
        "c.Png": r.integers(0, 256, (2, 2, 1), dtype=np.uint8),
    }
    (root / "sub").mkdir()
    for name, array in arrays.items():
        (root / "sub" / name).write_bytes(png(array))
    (root / "note.txt").write_text("x")
    return root, arrays


def test_read_stats(spark, folder):
    root, arrays = folder
    images = read_images(spark, str(root))
    assert images.count() == 3 and read_images(spark, str(root), limit=2).count() == 2
    dims = {r.origin.rsplit("/", 1)[1]: (r.height, r.width, r.channels) for r in I.image_dims(images).collect()}
    assert dims == {n: (*a.shape[:2], 3) for n, a in arrays.items()}
    for row in I.image_stats(images).collect():
        a = arrays[row.origin.rsplit("/", 1)[1]]
        rgb = (np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]) / 255.0
        assert [row.mean, row.std] == pytest.approx([rgb.mean(), rgb.std()])
        assert [row.mean_r, row.mean_g, row.mean_b] == pytest.approx(list(rgb.mean(axis=(0, 1))))
        assert [row.std_r, row.std_g, row.std_b] == pytest.approx(list(rgb.std(axis=(0, 1))))
    assert I.dataset_mean_std(images, 2).first().images == 2

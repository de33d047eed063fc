"""Small images and brute-force answers to compare with."""

from __future__ import annotations

from collections import deque

import numpy as np

from framelake import schemas


def golden_image() -> np.ndarray:
    y, x = np.mgrid[0:8, 0:8]
    image = 10.0 + ((x + 2 * y) % 3 - 1)
    for (row, column), value in {
        (2, 5): 200, (2, 6): 200, (3, 6): 200, (4, 7): 150, (6, 1): 22, (7, 7): 17, (0, 0): np.nan
    }.items():
        image[row, column] = value
    return image.astype(np.float32)


def frames_of(spark, images: dict[str, np.ndarray | None]):
    rows = []
    for name, image in images.items():
        if image is None:
            rows.append((name, 0, 0, [], "ERR:NoImageData"))
        else:
            rows.append((name, *image.shape, [float(v) for v in image.ravel()], "SUCCESS"))
    return spark.createDataFrame(rows, schemas.FRAMES)


def brute_components(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """8-connected regions by flood fill, in raster order of their first pixel."""
    seen, regions = np.zeros_like(mask, bool), []
    height, width = mask.shape
    for y in range(height):
        for x in range(width):
            if not mask[y, x] or seen[y, x]:
                continue
            seen[y, x], region, queue = True, [], deque([(y, x)])
            while queue:
                cy, cx = queue.popleft()
                region.append((cy, cx))
                for ny in range(max(cy - 1, 0), min(cy + 2, height)):
                    for nx in range(max(cx - 1, 0), min(cx + 2, width)):
                        if mask[ny, nx] and not seen[ny, nx]:
                            seen[ny, nx] = True
                            queue.append((ny, nx))
            regions.append(region)
    return regions


def fits_bytes(image: np.ndarray, bitpix: int = -32, cards: dict[str, str] | None = None,
               empty_first: bool = False) -> bytes:
    """An image file; ``empty_first`` puts the image behind a header without data."""
    kinds = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}

    def header(lines: list[str]) -> bytes:
        text = "".join(line.ljust(80) for line in [*lines, "END"]).encode()
        return text.ljust(-(-len(text) // 2880) * 2880)

    axes = [f"NAXIS   = {image.ndim:>20}"] + [
        f"NAXIS{i + 1}  = {n:>20}" for i, n in enumerate(reversed(image.shape))
    ]
    extra = [f"{name:<8}= {value:>20} / comment" for name, value in (cards or {}).items()]
    body = image.astype(kinds[bitpix]).tobytes()
    body = body.ljust(-(-len(body) // 2880) * 2880, b"\0")
    bits = f"BITPIX  = {bitpix:>20}"
    if empty_first:
        first = header(["SIMPLE  =                    T", "BITPIX  =                    8",
                        "NAXIS   =                    0"])
        return first + header(["XTENSION= 'IMAGE   '", bits, *axes, *extra]) + body
    return header(["SIMPLE  =                    T", bits, *axes, *extra]) + body

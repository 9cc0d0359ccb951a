"""Small arrays as cell tables."""

import numpy as np


def cells(spark, **bands):
    """Cells of equally shaped nested lists; None stays null."""
    first = next(iter(bands.values()))
    rows, cols = len(first), len(first[0])
    kinds = []
    for b in bands.values():
        given = [x for row in b for x in row if x is not None]
        kinds.append("double" if any(type(x) is float for x in given) else {bool: "boolean", str: "string", int: "long"}[type((given or [0])[0])])
    put = lambda v, k: float(v) if k == "double" and v is not None else v
    data = [(r, c, r * cols + c, *[put(b[r][c], k) for b, k in zip(bands.values(), kinds)]) for r in range(rows) for c in range(cols)]
    return spark.createDataFrame(data, ", ".join(["row int", "col int", "cell_id long", *[f"{n} {k}" for n, k in zip(bands, kinds)]]))


def band(df, name, key="cell_id"):
    return {r[key]: r[name] for r in df.select(key, name).collect()}


def random_terrain(seed, rows, cols):
    rng = np.random.default_rng(seed)
    return (rng.random((rows, cols)) * 10 + np.arange(rows)[:, None] * 2).tolist()

"""vecgrid: strings or vectors -> coordinates -> a browsable grid -> neighbour maps, on Spark."""

from vecgrid import sinks, sources, streaming
from vecgrid.functions import columns, features, smiles
from vecgrid.operators import forest, grid, maps, neighbours, quality, quantiles, ranking, reduce, sketches, stats
from vecgrid.plans import jobs

__all__ = [
    "columns",
    "features",
    "forest",
    "grid",
    "jobs",
    "maps",
    "neighbours",
    "quality",
    "quantiles",
    "ranking",
    "reduce",
    "sinks",
    "sketches",
    "smiles",
    "sources",
    "stats",
    "streaming",
]

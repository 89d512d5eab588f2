"""weftline: keyed, lineage-style data processing declared as Spark DataFrame plans."""

from weftline.engine import Engine
from weftline.operators.aggregators import Aggregator
from weftline.operators.dataset import Dataset
from weftline.operators.pairs import PairDataset

__all__ = ["Aggregator", "Dataset", "Engine", "PairDataset"]

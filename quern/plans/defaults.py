"""What indexes are made with unless said otherwise, and the catalogue that a new store begins with."""

from __future__ import annotations

from dataclasses import dataclass

#: The parameters of an index by kind.
INDEX = {"ivf": {"clusters": 10, "n_probe": 2}, "hnsw": {"m": 16, "ef_construction": 200, "ef_search": 50}}


@dataclass(frozen=True)
class CatalogueEntry:
    """An index: its name, kind, key columns, whether keys are unique, and columns that it carries along."""

    name: str
    kind: str
    columns: tuple[str, ...]
    unique: bool = False
    carried: tuple[str, ...] = ()


#: The indexes of a new store.
CATALOGUE = (
    CatalogueEntry("idx_tensor_timestamp", "btree", ("timestamp",)),
    CatalogueEntry("idx_collection_score", "btree", ("score",)),
    CatalogueEntry("idx_sequence_position", "btree", ("sequence_pos",)),
    CatalogueEntry("idx_tensor_id", "hash", ("tensor_id",), True),
    CatalogueEntry("idx_document_key", "hash", ("doc_key",), True),
    CatalogueEntry("idx_cache_hash", "hash", ("cache_hash",), True),
    CatalogueEntry("idx_model_name", "hash", ("model_name",), True),
    CatalogueEntry("idx_model_layer", "composite", ("model_name", "layer_id"), True),
    CatalogueEntry("idx_collection_timestamp", "composite", ("collection_name", "timestamp")),
    CatalogueEntry("cov_tensor_metadata", "covering", ("tensor_id",), False, ("shape", "dtype", "size_bytes", "storage_tier")),
    CatalogueEntry("cov_model_summary", "covering", ("model_name",), False, ("layer_count", "total_params", "quantization", "device")),
)


def index_parameters(kind: str = "ivf", **given: int) -> dict[str, int]:
    """The parameters of an index of that kind (ivf for any other than hnsw), those given in place of the defaults."""
    base = INDEX["hnsw" if kind == "hnsw" else "ivf"]
    return {k: given.get(k, v) for k, v in base.items()}

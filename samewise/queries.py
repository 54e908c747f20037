"""All queries of the engine; each catalogue adds its own."""

from samewise import catalogue_cleaning, catalogue_detail, catalogue_entities, catalogue_features, catalogue_linking, catalogue_more, catalogue_pairs, catalogue_training  # noqa: F401
from samewise.catalogue import FLAGSHIP, ORACLE_SQL, QUERIES  # noqa: F401

"""Training-data operators: language mixture, line and near-duplicate removal, licence scans,
token files, source mixing, packing, sharding, fingerprints, neighbour search, secret scans, ranked
lexical search and clustering.

Nothing else in the library imports this subpackage.
"""

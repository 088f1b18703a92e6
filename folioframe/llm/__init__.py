"""Training-data operators: deduplication, filtering, decontamination, privacy and packing.

Each module holds one operator with its general interface and the thin contract query
``opN_<name>``; ``registry`` lists the queries. Nothing outside this subpackage imports it.
"""

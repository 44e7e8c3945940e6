"""All queries of the core and their oracles."""

from strandbase.plans import edits, manifest_parts, manifests, star, structure

QUERIES = {**structure.QUERIES, **star.QUERIES, **manifests.QUERIES, **manifest_parts.QUERIES, **edits.QUERIES}
ORACLE = {**structure.ORACLE, **star.ORACLE, **manifests.ORACLE, **manifest_parts.ORACLE, **edits.ORACLE}

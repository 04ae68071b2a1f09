"""All queries of this subpackage."""

from corpusloom.llm import (  # noqa: F401
    decontaminate, fillmiddle, langid, minhash, packing, quality, rules, runs, sharding, suffix_dedup,
    tokencount, urlfilter, warc)
from corpusloom.llm.registry import ORACLES, QUERIES  # noqa: F401

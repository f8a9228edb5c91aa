"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import divergence, mixing, quality, topk
from .bestfit import op13_bestfit
from .divergence import op11_divergence
from .langid import op7_langid
from .licenses import op5_licenses
from .mixing import op10_mixing
from .packing import op1_packing
from .periodic import op12_periodic
from .pii import op3_pii
from .quality import op4_quality
from .simhash import op8_simhash
from .store import op9_store
from .topk import op6_topk
from .urls import op2_urls

QUERIES = {"op1_packing": op1_packing, "op2_urls": op2_urls, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_licenses": op5_licenses, "op6_topk": op6_topk, "op7_langid": op7_langid, "op8_simhash": op8_simhash, "op9_store": op9_store, "op10_mixing": op10_mixing, "op11_divergence": op11_divergence, "op12_periodic": op12_periodic, "op13_bestfit": op13_bestfit}

ORACLES: dict[str, str] = {"op4_quality": quality.ORACLE, "op6_topk": topk.ORACLE, "op10_mixing": mixing.ORACLE, "op11_divergence": divergence.ORACLE}

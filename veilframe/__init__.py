"""Privacy-first document corpora on Spark. Names are loaded when they are first used, so that importing the package needs no Spark."""

from importlib import import_module

_NAMES = {
    "Config": "config:Config", "ConflictError": "operators.vault:ConflictError", "EgressError": "operators.egress:EgressError", "ResidueError": "operators.residue:ResidueError", "assert_clean": "operators.residue:assert_clean",
    "assert_safe": "operators.egress:assert_safe", "case_review": "plans.review:reviewed", "declutter": "operators.declutter:declutter", "deidentify": "operators.deid:deidentify", "from_preview": "plans.ingest:from_preview",
    "guideline_link": "sources.knowledge:guideline_link", "ingest": "plans.ingest:ingest", "letters": "operators.report:letters", "load_config": "config:load", "monitor": "operators.report:monitor", "preview": "plans.ingest:preview",
    "prompted_detector": "operators.detectors:prompted", "pubmed": "sources.knowledge:pubmed", "render": "operators.vault:render", "residue_report": "operators.residue:report", "search": "operators.memory:search",
    "semantic_scholar": "sources.knowledge:semantic_scholar", "texts": "sources.documents:texts",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    module, attribute = _NAMES[name].split(":")
    return getattr(import_module(f"{__name__}.{module}"), attribute)

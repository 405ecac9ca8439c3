"""Settings of a set and of a run, as plain dictionaries."""

from __future__ import annotations

#: Defaults of a retrieval run.
RETRIEVAL = {
    "run_name": "default",
    "run_mode": "iterative_late_interaction",
    "modality_mode": "aware",
    "num_iterations": 1,
    "beam_width": 30,
    "hop_mode": "1_hop",
    "target_level": "top",
    "top_k": 100,
    "force_overwrite": False,
}
#: Fixed value: what a set must say about itself.
SET_KEYS = ("type", "qa_schema", "document_granularity", "needs_dereference", "filename")
#: Fixed value: the least that a parsed document has.
DOCUMENT_KEYS = ("title", "text", "image")


def run_config(**changes) -> dict:
    """The defaults with changes; an unknown name is an error."""
    unknown = sorted(set(changes) - set(RETRIEVAL))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return RETRIEVAL | {k: v for k, v in changes.items() if v is not None}

"""Options of a linking run."""

from __future__ import annotations

from dataclasses import dataclass

from tablelink.functions.formats import ANSWER_MARKER
from tablelink.functions.prompts import TEMPLATES

LAYOUTS = ("tagged", "pipe")
POLICIES = ("replace", "append", "plain")
GUARDS = ("intended", "as_written")
RETRIEVALS = ("label", "search", "fuzzy")


@dataclass(frozen=True)
class LinkConfig:
    """What a linking run renders, how it retrieves and how often it repeats.

    dataset, config   names written with every result row
    template          a name of TEMPLATES, or a template text with {fields}
    layout            candidate text layout, one of LAYOUTS
    policy            what retrieval does to the candidates, one of POLICIES
    guard             how retrieved text is checked, one of GUARDS
    runs              repeats per mention
    candidate_limit   candidates kept per mention; None keeps the whole list
    prompt_budget     tokens of a prompt; of its candidates, the first ones that fit are
                      kept. None keeps them all
    retrieval         how entities are found, one of RETRIEVALS: by equal label, by the
                      words of label and description, or by a label a few edits away
    retrieval_limit   entities kept per looked-up mention
    marker            cut the answer after this marker; None keeps it whole
    """

    dataset: str
    config: str
    template: str = "link_wiki"
    layout: str = "tagged"
    policy: str = "replace"
    guard: str = "intended"
    runs: int = 3
    candidate_limit: int | None = None
    prompt_budget: int | None = None
    retrieval: str = "label"
    retrieval_limit: int = 20
    marker: str | None = None

    def __post_init__(self):
        for name, value, allowed in (
            ("layout", self.layout, LAYOUTS),
            ("policy", self.policy, POLICIES),
            ("guard", self.guard, GUARDS),
            ("retrieval", self.retrieval, RETRIEVALS),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
        if self.runs < 1:
            raise ValueError("runs must be at least 1")
        if self.template not in TEMPLATES and "{" not in self.template:
            raise ValueError(f"unknown template {self.template!r}")

    @property
    def template_text(self) -> str:
        return TEMPLATES.get(self.template, self.template)


def fine_tuned_config(dataset: str, config: str, **options) -> LinkConfig:
    """The settings of the fine-tuned runs: marked prompt and answer, no guard."""
    settings = {"template": "sft_infer", "policy": "plain", "marker": ANSWER_MARKER}
    return LinkConfig(dataset, config, **{**settings, **options})

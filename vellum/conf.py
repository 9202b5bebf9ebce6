"""Configuration: a closed schema of defaults, overlaid by a JSON object."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

#: Defaults.  An empty object is a free table: any keys may be set in it.
DEFAULTS: dict[str, Any] = {
    "course": {"code": "", "title": ""},
    "paths": {"labo": "Labo", "syllabus_src": "Theorie/Syllabus/Theorie", "syllabus_dir": "Theorie/Syllabus", "decks": "Hoorcollege", "downloads": "downloads", "img": "img", "toets": "_toets"},
    "staging": ["_incoming", "_export", "_oplossingen", "_toets", "_feedback"],
    "exempt_pages": ["template.html"],
    "non_site_dirs": ["Hoorcollege"],
    "menu": "menu.json",
    "theme": {"css": "https://theme.example/style.css", "js": "https://theme.example/main.js"},
    "check": {
        "disable": {},
        "orphan_roots": ["Labo"],
        "remote_document_exts_extra": [],
        "code_style_languages": ["arduino", "cpp", "c", "csharp", "python"],
        "skip_pages": [],
        "exercise_title_words": ["oefening", "opdracht"],
        "names": {"ungraded": "Verslag", "test": "Test labo", "graded": "Opdracht"},
        "retired_hosts": ["chamilo"],
        "platform_paths": ["content/enforced"],
        "retired_scripts": ["oplossingen.js", "solution-reveal.js"],
        "shared_words": 7,
        "audit": {
            "stock_lead_extra": [],
            "diminutives_extra": [],
            "noord_nl_extra": [],
            "fillers_extra": [],
            "identifier_words": [],
            "code_languages": [],
            "code_no_badge": ["plaintext"],
            "lead_patterns": ["*"],
            "figure_patterns": ["*"],
            "exercise_patterns": [],
        },
    },
    "syllabus": {"manifest": "reference.js", "pdf": "", "logo": ""},
    "handout": {"prefix": ""},
    "skills": {"folder": ".claude/skills", "prefix": "base-", "base": {}},
    "style_guide": {"file": "SCHRIJFSTIJL.md", "reference": "base/SCHRIJFSTIJL.md", "base_numbers": []},
    "import": {"max_mb": 50, "doc_exts": [".pdf", ".zip"], "start_exts": [], "page_depth": 2},
    "feedback": {"footer": "", "empty_template": ""},
    "quiz": {"coverage": [], "objectives": [], "settings": {}},
}


class ConfigError(ValueError):
    """An unknown key or a value of the wrong type."""


def merge(defaults: dict, own: Any, path: str = "") -> dict:
    """Defaults overlaid by own; keys that begin with _ are comments; lists replace."""
    if not isinstance(own, dict):
        raise ConfigError(f"{path or 'the root'} must be an object")
    out = copy.deepcopy(defaults)
    for key, value in own.items():
        where = f"{path}.{key}".lstrip(".")
        if key.startswith("_"):
            continue
        if key not in defaults:
            raise ConfigError(f"unknown key {where}")
        base = defaults[key]
        if isinstance(base, dict):
            if base:
                value = merge(base, value, where)
            elif not isinstance(value, dict):
                raise ConfigError(f"{where} must be an object")
        elif base is not None and not isinstance(value, type(base)):
            raise ConfigError(f"{where} must be of type {type(base).__name__}")
        out[key] = value
    return out


def load(path: str | Path) -> dict:
    """The merged configuration of a JSON file."""
    try:
        return merge(DEFAULTS, json.loads(Path(path).read_text(encoding="utf-8")))
    except FileNotFoundError:
        raise ConfigError(f"{path} is missing") from None

"""Driver-side upkeep: backup, restore, schedules, exports, evaluation files."""

from __future__ import annotations

import json
import os
import shutil
import tarfile
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

import yaml


@dataclass(frozen=True)
class Backup:
    path: str
    size: int
    made: str


def backup(data_dir: str, to_dir: str, now: datetime | None = None) -> Backup:
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S")
    os.makedirs(to_dir, exist_ok=True)
    path = os.path.join(to_dir, f"data-{stamp}.tar.gz")
    with tarfile.open(path, "w:gz") as tar:
        tar.add(data_dir, arcname="data")
    return Backup(path, os.path.getsize(path), stamp)


def restore(archive: str, data_dir: str) -> str | None:
    """Unpack beside data_dir, move the live folder aside, and swap; returns where the old one went."""
    parent = os.path.dirname(os.path.abspath(data_dir))
    with tempfile.TemporaryDirectory(dir=parent) as tmp:
        with tarfile.open(archive) as tar:
            tar.extractall(tmp, filter="data")
        aside = None
        if os.path.exists(data_dir):
            aside = f"{data_dir}.before-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
            os.rename(data_dir, aside)
        shutil.move(os.path.join(tmp, "data"), data_dir)
    return aside


def list_backups(to_dir: str) -> list[Backup]:
    names = sorted(n for n in (os.listdir(to_dir) if os.path.isdir(to_dir) else []) if n.startswith("data-") and n.endswith(".tar.gz"))
    return [Backup(os.path.join(to_dir, n), os.path.getsize(os.path.join(to_dir, n)), n[len("data-") : -len(".tar.gz")]) for n in names]


def load_golden(path: str) -> list[dict]:
    """Evaluation items of a YAML file; none if there is no file."""
    if not os.path.exists(path):
        return []
    with open(path) as f:
        rows = yaml.safe_load(f) or []
    base = {"expected_sources": [], "expected_answer_contains": [], "tags": [], "notes": ""}
    return [base | {"id": str(r["id"])} | {k: v for k, v in r.items() if k != "id" and v is not None} for r in rows]


def run_eval(golden: list[dict], find: Callable[[str], list[tuple[str, str, float]]], answer: Callable[[str], str], top_k: int = 8) -> dict:
    """Ask every golden question: per item hit rate of sources, share of strings in the answer, and their means.

    find gives (source, text, score), answer the text. What is expected of no kind counts
    as met. An item whose question raises is reported with the error and scores 0.
    """
    items = []
    for g in golden:
        question = g.get("question") or g["id"]
        try:
            hits, text = find(question)[:top_k], answer(question)
        except Exception as e:  # one bad question must not end the run
            items.append({"id": g["id"], "source_hit_rate": 0.0, "answer_hit_rate": 0.0, "error": str(e)})
            continue
        share = lambda wanted, there: sum(map(there, wanted)) / len(wanted) if wanted else 1.0
        items.append({
            "id": g["id"], "source_hit_rate": share(g["expected_sources"], lambda s, hits=hits: any(s in x for x, _, _ in hits)),
            "answer_hit_rate": share(g["expected_answer_contains"], lambda s, text=text: s.lower() in text.lower()),
        })
    mean = lambda name: sum(x[name] for x in items) / len(items) if items else 0.0
    return {"items": items, "n": len(items), "errors": sum("error" in x for x in items), "source_hit_rate": mean("source_hit_rate"), "answer_hit_rate": mean("answer_hit_rate")}


def write_report(path: str, report: dict) -> None:
    """A report as JSON; the file is put in place whole."""
    with open(f"{path}.part", "w") as f:
        json.dump(report, f, indent=1, ensure_ascii=False)
    os.replace(f"{path}.part", path)


def append_section(path: str, title: str, body: str, now: datetime) -> None:
    with open(path, "a") as f:
        f.write(f"\n## {title} ({now:%Y-%m-%d %H:%M})\n\n{body}\n")


def doctor(paths: list[str], least_gb: float = 1.0) -> list[tuple[str, bool, str]]:
    """Checks as (name, passed, detail): folders can be written and have room."""
    out = []
    for p in paths:
        ok = os.path.isdir(p) and os.access(p, os.W_OK)
        out.append((f"writable {p}", ok, "" if ok else "missing or read-only"))
        if ok:
            free = shutil.disk_usage(p).free / 1e9
            out.append((f"disk {p}", free >= least_gb, f"{free:.1f} GB free"))
    return out

"""First steps: folders, a seed corpus, the model, and a snapshot of what the server has."""

from __future__ import annotations

import json
import os
import shutil
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from textloom.sources import corpus
from textloom.sources.model_server import ModelServer


def folders(root: str) -> dict[str, str]:
    root = os.path.abspath(root)
    if os.path.basename(root).lower() == "current":
        root = os.path.dirname(root)
    current, models = os.path.join(root, "current"), os.path.join(root, "models")
    return {"root": root, "current": current, "data": os.path.join(current, "data"), "models": models, "models_current": os.path.join(models, "current"), "releases": os.path.join(models, "releases")}


def point(link: str, target: str) -> bool:
    """Make a link to a folder, in place of the link or folder there; where links can't be made, a copy. Returns whether it is a link."""
    if os.path.islink(link) or os.path.isfile(link):
        os.unlink(link)
    elif os.path.isdir(link):
        shutil.rmtree(link)
    try:
        os.symlink(target, link, target_is_directory=True)
        return True
    except (OSError, NotImplementedError):
        shutil.copytree(target, link)
        return False


def setup(spark: SparkSession, root: str, server: ModelServer, now: datetime | None = None) -> dict[str, str]:
    """Make what is missing and return where it is."""
    at = folders(root)
    for path in at.values():
        os.makedirs(path, exist_ok=True)
    path = os.path.join(at["data"], "corpus.jsonl")
    corpus.ensure(spark, f"file://{path}")
    server.ensure()
    stamp = (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    release = os.path.join(at["releases"], f"{server.model.replace(':', '-')}-{stamp}")
    os.makedirs(release, exist_ok=True)
    for name, text in (("manifest.txt", server.show()), ("tags.json", json.dumps({"models": [{"name": t} for t in server.tags()]}))):
        with open(os.path.join(release, name), "w", encoding="utf-8") as f:
            f.write(text)
    link = os.path.join(at["models_current"], "model")
    point(link, release)
    return {"corpus": path, "release": release, "link": link, "model": server.model, "host": server.host, "root": at["root"]}

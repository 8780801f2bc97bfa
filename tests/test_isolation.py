"""Nothing outside the training-text subpackage names it, but for the driver's entry."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_no_module_outside_imports_the_subpackage():
    files = [*(p for p in (ROOT / "skein").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]
    for path in files:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or "corpus_pipeline" in n for n in names), path

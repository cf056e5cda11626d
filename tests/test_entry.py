import subprocess
import sys


def test_entry_works_without_the_text_operators():
    code = "import sys; sys.modules['pixelplan.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') and k[2].isdigit() for k in e.queries()), 'pipeline' in e.queries(), {*e.oracle_sql()} <= {*e.queries()})"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(said[0]) > 70 and said[1:] == ["False", "False", "True"]


def test_library_does_not_import_the_text_operators():
    import ast
    import pathlib

    import pixelplan

    root = pathlib.Path(pixelplan.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [node.module or "", *(x.name for x in node.names)] if isinstance(node, ast.ImportFrom) else [x.name for x in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in name.split(".") or name == "corpus_pipeline" for name in names), file

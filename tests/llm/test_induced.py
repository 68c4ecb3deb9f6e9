"""The prototype of external induced sorting sorts."""

import importlib.util
import random
from pathlib import Path


def test_prototype_sorts_suffixes():
    spec = importlib.util.spec_from_file_location("induced", Path(__file__).with_name("induced.py"))
    induced = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(induced)
    rnd = random.Random(2)
    for _ in range(40):
        text = [rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 300))]
        told = {"written": 0}
        assert induced.suffixes(text, 20, told) == sorted(range(len(text)), key=lambda i: text[i:])

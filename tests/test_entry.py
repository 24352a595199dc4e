"""The entry module imports wherever Spark's own files are."""

import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

from placerank.constants import ENGLISH_STOP_WORDS

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_jars_beside_pyspark():
    code = (
        "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 100


def test_entry_imports_without_a_library_of_the_optional_operators():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 100


def test_stop_words_are_those_of_spark(spark):
    assert StopWordsRemover.loadDefaultStopWords("english") == ENGLISH_STOP_WORDS

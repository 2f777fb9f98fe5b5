"""Stop-word lists.

The default English list is the one shipped with Spark ML (``StopWordsRemover``), read from the
Spark ML jar so no word list is kept in this repository. It has 181 words; the reference's
vectoriser uses another, longer list, so results with stop words differ from it by design. Any
other list can be passed wherever ``stop_words`` is a parameter.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile


@functools.lru_cache(maxsize=None)
def spark_stop_words(language: str = "english") -> tuple[str, ...]:
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = f"org/apache/spark/ml/feature/stopwords/{language}.txt"
            if name in z.namelist():
                return tuple(w for w in z.read(name).decode("utf-8").split() if w)
    # A session can always supply it, but a scan of the jar avoids needing one.
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))

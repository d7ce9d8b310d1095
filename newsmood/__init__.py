"""newsmood: news and document text analytics as DataFrame jobs on Spark.

Every operator takes a DataFrame and returns a DataFrame (or builds a Column);
nothing here collects article rows on the driver.
"""

from newsmood.schema import ARTICLE, INGEST_LOG, STORED
from newsmood.session import build_session, prepare, work_path

__all__ = ["ARTICLE", "STORED", "INGEST_LOG", "build_session", "prepare", "work_path"]

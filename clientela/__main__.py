"""``python -m clientela DATA_DIR OUT_DIR [LINES]``: run all reports.

LINES is a file in DATA_DIR with the items of the tickets, for the baskets. The
session takes its master and settings from ``spark-submit`` or the environment.
"""

import sys

from pyspark.sql import SparkSession

from clientela.plans.reports import write_reports

if __name__ == "__main__":
    if len(sys.argv) not in (3, 4):
        sys.exit("usage: python -m clientela DATA_DIR OUT_DIR [LINES]")
    write_reports(SparkSession.builder.appName("clientela").getOrCreate(), *sys.argv[1:])

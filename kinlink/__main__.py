"""python -m kinlink DATASET WORK OUT [score]: links the test files of a dataset after training on its train files, or, with
`score`, by what an earlier run saved below WORK."""

import sys

from pyspark.sql import SparkSession

from kinlink.plans import linkage

if __name__ == "__main__":
    if len(sys.argv) not in (4, 5) or sys.argv[4:] not in ([], ["score"]):
        sys.exit(__doc__)
    spark = SparkSession.builder.appName("kinlink").getOrCreate()
    if sys.argv[4:]:
        linkage.score(*sys.argv[1:4], spark)
    else:
        linkage.run(*sys.argv[1:4], spark)

"""cohortlab: outcome analytics on Spark."""
import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers travel with the job, so a worker needs
# neither the repository on its path nor a shared folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Where the tests find their data (a module of its own name: several folders have a conftest)."""
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
IRIS = os.path.join(ROOT, "tests", "data", "iris.csv")
SF = "/root/testdata/sf0.001"

import importlib.util

import pytest

if importlib.util.find_spec("public_tokenizers") is None:
    pytest.skip("the vocabulary files are not installed", allow_module_level=True)

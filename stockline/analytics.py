"""Every read query: ``analytics.<key>(tables, **params) -> DataFrame``."""

from stockline.plans.catalogue import *  # noqa: F401,F403
from stockline.plans.intelligence import *  # noqa: F401,F403
from stockline.plans.ledger import *  # noqa: F401,F403
from stockline.plans.pricing import *  # noqa: F401,F403
from stockline.plans.stock import *  # noqa: F401,F403
from stockline.plans.trading import *  # noqa: F401,F403

stock_status = stock_status_list  # noqa: F405

"""Complete reports: each takes the source tables and parameters and returns a DataFrame."""

from prospectus.plans.analysis import portfolio_analysis
from prospectus.plans.flows import dropped_nn_dq, prospects_added, prospects_dropped
from prospectus.plans.officer_management import om_proposals, om_prospects, om_visits
from prospectus.plans.percents import portfolio_percents
from prospectus.plans.proposal_stats import proposal_stats
from prospectus.plans.scorecard import officer_scorecard

__all__ = [
    "dropped_nn_dq",
    "officer_scorecard",
    "om_proposals",
    "om_prospects",
    "om_visits",
    "portfolio_analysis",
    "portfolio_percents",
    "proposal_stats",
    "prospects_added",
    "prospects_dropped",
]

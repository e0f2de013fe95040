"""The probabilistic model: priors, likelihoods, artifacts and event posteriors."""

from cartpulse.jobs import main

main()

from turnloom.plans.files import main

main()
